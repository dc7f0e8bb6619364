"""keelson: repository-health analytics expressed as Spark DataFrame plans.

Every metric is computed for all repositories in one job (grouped by
``repo_full_name``); a single repository is just a filter on the result.
"""

from keelson.session import get_session

__all__ = ["get_session"]
