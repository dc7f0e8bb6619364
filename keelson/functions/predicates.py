"""Row predicates shared by the metrics (pure Column expressions)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from keelson.functions.time import ts_lit, ts_sql

# Bot accounts excluded from responses and reviews (case-sensitive).
BOT_PREFIXES = ("dependabot", "github-actions")
BOT_SUFFIXES = ("[bot]",)
BOT_NAMES = ("codecov",)


def bot_sql(author: str) -> str:
    """SQL text of the bot test for a column name."""
    a = f"`{author}`"
    terms = [f"startswith({a}, '{p}')" for p in BOT_PREFIXES]
    terms += [f"endswith({a}, '{s}')" for s in BOT_SUFFIXES]
    terms += [f"{a} = '{n}'" for n in BOT_NAMES]
    return "(" + " OR ".join(terms) + ")"


def is_bot(author: str | Column) -> Column:
    if isinstance(author, str):
        return F.expr(bot_sql(author))
    a = author
    cond = None
    for p in BOT_PREFIXES:
        term = a.startswith(p)
        cond = term if cond is None else cond | term
    for s in BOT_SUFFIXES:
        cond = cond | a.endswith(s)
    for n in BOT_NAMES:
        cond = cond | (a == n)
    return cond


def not_bot(author: str | Column) -> Column:
    """True for human authors; NULL author gives NULL, which a filter drops."""
    if isinstance(author, str):
        return F.expr(f"NOT {bot_sql(author)}")
    return ~is_bot(author)


def older_than(column: str | Column, days: int, reference: datetime) -> Column:
    """``column < reference - days``: created more than ``days`` before ``reference``."""
    if isinstance(column, str):
        return F.expr(f"`{column}` < {ts_sql(reference - timedelta(days=days))}")
    return column < ts_lit(reference - timedelta(days=days))


def stale_by_hours(column: str | Column, hours: int, reference: datetime) -> Column:
    if isinstance(column, str):
        return F.expr(f"{ts_sql(reference - timedelta(hours=hours))} > `{column}`")
    return ts_lit(reference - timedelta(hours=hours)) > column
