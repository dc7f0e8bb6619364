"""Registered queries: one Spark plan and (where SQL can say it) one oracle each.

Every query reads the whole testdata tables of ``sf_dir`` through
:mod:`keelson.sources.bindings`; parameters (windows, ``as_of``, limits) are
fixed per query so the Spark result and the oracle result are comparable.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from keelson.functions.time import Window
from keelson.plans.export import as_wall_clock
from keelson.session import configure
from keelson.sources.bindings import EVENT_AS_OF, ORDER_AS_OF, Bindings


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Bindings], DataFrame]
    oracle: str | None
    description: str = ""

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return as_wall_clock(self.build(Bindings(spark, sf_dir)))


REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None, description: str = ""):
    def deco(fn: Callable[[Bindings], DataFrame]):
        REGISTRY[name] = Query(name, fn, oracle, description)
        return fn

    return deco


def sql_ts(value: datetime) -> str:
    return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S.%f}'"


def sql_window(window: Window, column: str) -> str:
    ends = ((">=", window.start), ("<", window.end))
    return " AND ".join([f"{column} IS NOT NULL", *(f"{column} {op} {sql_ts(at)}" for op, at in ends if at)])


ALL = Window.all()
RECENT_180 = Window.trailing(180, ORDER_AS_OF)
RECENT_30_EVENTS = Window.trailing(30, EVENT_AS_OF)
ORDER_AS_OF_SQL = sql_ts(ORDER_AS_OF)
EVENT_AS_OF_SQL = sql_ts(EVENT_AS_OF)

__all__ = [
    "ALL",
    "EVENT_AS_OF",
    "EVENT_AS_OF_SQL",
    "ORDER_AS_OF",
    "ORDER_AS_OF_SQL",
    "RECENT_180",
    "RECENT_30_EVENTS",
    "REGISTRY",
    "Query",
    "register",
    "sql_ts",
    "sql_window",
]


def load_all() -> dict[str, Query]:
    """Import every query module so their ``@register`` calls run."""
    from keelson.plans import q_ingest, q_metrics, q_reports, q_rollup, q_runs, q_streaming, q_windows  # noqa: F401

    return REGISTRY
