"""Months of activity of every author as bits (AGG10-AGG13, M8), mergeable batch by batch.

A state row (repository, author, word, months) holds 32 months: bit ``b`` of word
``w`` is month ``32 w + b``, counted from year 0. ``bit_or`` merges states, so
new commits are folded into what is stored without the old ones. An author's
cohort is the lowest bit of the first word; the twelve months after it are a
shift over that word and the next. Nothing is ordered and no distinct is counted:
a hot repository is one row from each task and author.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.operators.kpis import REPO

#: Months in a word, and months of a cohort that are followed (its own first).
WORD, FOLLOWED = 32, 13


def months_of(activity: DataFrame) -> DataFrame:
    """State of rows (repository, author, occurred_at)."""
    month = F.expr("CAST(year(occurred_at) * 12 + month(occurred_at) - 1 AS BIGINT)")
    return (
        activity.select(REPO, "author", month.alias("_m"))
        .groupBy(REPO, "author", F.expr(f"_m div {WORD}").alias("word"))
        .agg(F.expr(f"bit_or(shiftleft(1L, CAST(_m % {WORD} AS INT)))").alias("months"))
    )


def merged(*states: DataFrame) -> DataFrame:
    """The state of all activity that any of ``states`` saw."""
    every = states[0]
    for s in states[1:]:
        every = every.unionByName(s)
    return every.groupBy(REPO, "author", "word").agg(F.bit_or("months").alias("months"))


def cohorts(state: DataFrame) -> DataFrame:
    """(repository, author, cohort, followed): first month, and bit ``k`` where the author is active ``k`` months later."""
    words = F.sort_array(F.collect_list(F.struct("word", "months")))  # one row for 32 months of an author
    rows = state.groupBy(REPO, "author").agg(words.alias("w"))
    return rows.selectExpr(
        REPO, "author", "w[0].word AS _word", "w[0].months AS _low",
        "CASE WHEN w[0].word + 1 = try_element_at(w, 2).word THEN w[1].months ELSE 0L END AS _high",
    ).selectExpr(
        "*", "bit_count(~_low & (_low - 1)) AS _first"  # zeros below the lowest bit
    ).selectExpr(
        REPO, "author", f"_word * {WORD} + _first AS cohort",
        f"shiftrightunsigned(_low | shiftleft(_high, {WORD}), _first) & {(1 << FOLLOWED) - 1}L AS followed",
    )


def retention(state: DataFrame) -> DataFrame:
    """(repository, cohort_month, month_number, cohort_size, active_contributors) of months with someone active."""
    counts = cohorts(state).groupBy(REPO, "cohort").agg(
        *[F.expr(f"count_if(followed & {1 << k}L <> 0) AS _{k}") for k in range(FOLLOWED)]
    )
    cells = ", ".join(f"{k}L, _{k}" for k in range(FOLLOWED))
    return counts.selectExpr(
        REPO, "cast(make_date(cast(cohort div 12 as int), cast(cohort % 12 + 1 as int), 1) as timestamp) AS cohort_month",
        "_0 AS cohort_size", f"stack({FOLLOWED}, {cells}) AS (month_number, active_contributors)",
    ).where("active_contributors > 0")
