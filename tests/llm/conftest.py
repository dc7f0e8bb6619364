from __future__ import annotations

import pytest

from keelson.llm.q_llm import prepare


@pytest.fixture(autouse=True)
def _prepared(spark):
    prepare(spark)
