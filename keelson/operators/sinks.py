"""Sinks: JSON summary per repository and CSV exports (SNK11-13).

Writers go through the DataFrame writer, so exports are produced by the
executors in parallel (one file per partition) rather than on the driver.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions.time import Window, iso_z
from keelson.operators import coverage as cov
from keelson.operators import kpis, rules
from keelson.operators.kpis import REPO


def _named_struct(cols: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {e}" for n, e in cols.items()) + ")"


def summary_json(tables, window: Window, as_of: datetime) -> DataFrame:
    """One JSON document per repository: overview, issue / PR / contributor KPIs,
    coverage rows and data-quality flags (NULL fields kept, timestamps ISO-Z)."""
    coverage = cov.coverage(tables, tables.page_log)
    cov_rows = coverage.groupBy(REPO).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "entity_type",
                    "record_count",
                    iso_z("first_observed_at").alias("first_observed_at"),
                    iso_z("last_observed_at").alias("last_observed_at"),
                    "pages_fetched",
                    "max_pages",
                    "last_run_truncated",
                    "history_complete",
                    "coverage_scope",
                    iso_z("refreshed_at").alias("refreshed_at"),
                )
            )
        ).alias("coverage")
    )
    flags = rules.quality_flags(tables, coverage, as_of)
    flag_rows = flags.groupBy(REPO).agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "level", "code", "detail"))).alias(
            "data_quality"
        )
    )
    repo_cols = tables.repositories.select(
        REPO, *[c for c in kpis.REPO_COLUMNS if c != "fetched_at"], iso_z("fetched_at").alias("fetched_at")
    )
    parts = [
        repo_cols,
        *kpis._overview_parts(tables),
        *kpis._issue_parts(tables, window, as_of),
        *kpis._pr_parts(tables, window),
        *kpis._contributor_parts(tables, window, as_of),
        cov_rows,
        flag_rows,
    ]
    overview_cols = {REPO: REPO, **{c: c for c in kpis.REPO_COLUMNS}, **kpis._overview_cols()}
    payload = _named_struct(
        {
            "repository": REPO,
            "overview": _named_struct(overview_cols),
            "issues": _named_struct(kpis._issue_cols()),
            "pull_requests": _named_struct(kpis._pr_cols()),
            "contributors": _named_struct(kpis._contributor_cols()),
            "coverage": "coalesce(coverage, array())",
            "data_quality": "coalesce(data_quality, array())",
        }
    )
    return kpis.merge_by_repo(parts).selectExpr(
        REPO, f"to_json({payload}, map('ignoreNullFields', 'false')) AS summary"
    )


def write_summary(df: DataFrame, path: str) -> None:
    df.select("summary").write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Metric / comparison CSV export with a header row."""
    df.write.mode("overwrite").option("header", True).csv(path)
