"""Numeric helpers that reproduce the reference engine's floating-point results.

* ``round_half_away`` / ``round_half_even``: round ``x * 10^d`` to an integer
  then divide, which is how the reference's SQL engine rounds DOUBLEs.
* ``fma_sql``: fused multiply-add ``a * b + c`` with a single rounding, built
  from error-free transformations (Dekker's TwoProduct, Knuth's TwoSum) as
  plain double arithmetic, so it stays inside whole-stage codegen.
* ``interpolated_quantiles``: exact continuous quantiles (linear interpolation
  between the order statistics at floor/ceil of ``(n - 1) * p``), computed as
  ``fma(lo, 1 - d, hi * d)`` like the reference engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of the quantile scale to a doubling of ``1 + |value|``.
SLOTS = 256
_SPLIT = 134217729.0  # 2**27 + 1, Veltkamp splitter for IEEE doubles


def round_half_away(x: Column, digits: int = 1) -> Column:
    m = float(10**digits)
    return F.round(x * F.lit(m), 0) / F.lit(m)


def round_half_even(x: Column, digits: int = 1) -> Column:
    m = float(10**digits)
    return F.bround(x * F.lit(m), 0) / F.lit(m)


def fma_sql(a: str, b: str, c: str) -> str:
    """SQL text of ``a * b + c`` rounded once (all operands DOUBLE expressions).

    Error-free transformations: Veltkamp split + Dekker's TwoProduct give
    ``a*b == p + e`` exactly, Knuth's TwoSum gives ``p + c == s + t`` exactly,
    and ``s + (t + e)`` is the fused result. Repeated sub-terms are shared at
    run time by whole-stage codegen's subexpression elimination.
    """
    a, b, c = f"({a})", f"({b})", f"({c})"
    p = f"({a} * {b})"
    ta, tb = f"({a} * {_SPLIT})", f"({b} * {_SPLIT})"
    ah, bh = f"({ta} - ({ta} - {a}))", f"({tb} - ({tb} - {b}))"
    al, bl = f"({a} - {ah})", f"({b} - {bh})"
    e = f"((({ah} * {bh} - {p}) + {ah} * {bl} + {al} * {bh}) + {al} * {bl})"
    s_ = f"({p} + {c})"
    bb = f"({s_} - {p})"
    t = f"(({p} - ({s_} - {bb})) + ({c} - {bb}))"
    return f"({s_} + ({t} + {e}))"


def interpolated_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    values_as: str | None = None,
    rows_as: str | None = None,
    counts_if: dict[str, str] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """One row per group with one column per requested quantile (NULL if no values).

    A selection in rounds, so that no task holds all values of a group:

    1. rows are reduced to (group, value, frequency) by a partial aggregate;
    2. each slot of a monotone scale, ``SLOTS`` to a doubling, is sorted on its
       own; its last value stands for the slot;
    3. prefix sums over the slots' last values (some thousands of a group,
       however many values it has) tell how many values lie before each slot;
    4. every value learns that from its slot, and those at the wanted ranks are taken.

    NULL values have a slot of their own, so ``values_as`` / ``rows_as`` can
    return the non-NULL and total row counts from the same pass, and
    ``counts_if`` (``name -> SQL condition``) adds conditional row counts per group.
    With ``weight``, a row stands for that many rows, and ``counts_if`` names the
    numbers to sum instead of conditions.
    """
    counts_if = counts_if or {}
    keys_sql = ", ".join(f"`{k}`" for k in keys)
    v = f"`{value}`"
    slot = f"CAST(floor(signum({v}) * log2(1.0D + abs({v})) * {SLOTS}.0D) AS BIGINT) AS _slot"
    rows, counted = ("count(1)", "count_if") if weight is None else (f"sum(`{weight}`)", "sum")
    freq = df.groupBy(*keys, value).agg(
        F.expr(f"{rows} AS _c"), *[F.expr(f"{counted}({c}) AS `{n}`") for n, c in counts_if.items()]
    ).selectExpr("*", slot)
    slot_of = f"PARTITION BY {keys_sql}, _slot"
    alone = freq.selectExpr(
        *[f"`{k}`" for k in keys], v, "_slot", "_c",
        f"sum(_c) OVER ({slot_of} ORDER BY {v} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _run",
        f"sum(_c) OVER ({slot_of}) AS _in",
        *[f"sum(`{n}`) OVER ({slot_of}) AS `{n}`" for n in counts_if],
    ).selectExpr("*", "_run = _in AS _last")
    # the slots' last values of a group meet; all other values stay where their slot puts them
    stand = f"PARTITION BY {keys_sql}, CASE WHEN NOT _last THEN _slot END"
    known = "CASE WHEN _slot IS NOT NULL THEN _in ELSE 0 END"
    totals = [*(f"`{n}`" for n in counts_if), "_n", "_rows"]
    stood = alone.selectExpr(
        *[f"`{k}`" for k in keys], v, "_slot", "_c", "_run", "_last",
        f"sum({known}) OVER ({stand} ORDER BY _slot ASC NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - {known} AS _from",
        *[f"sum(`{n}`) OVER ({stand}) AS `{n}`" for n in counts_if],
        f"sum({known}) OVER ({stand}) AS _n", f"sum(_in) OVER ({stand}) AS _rows",
    )
    ranked = stood.selectExpr(
        *[f"`{k}`" for k in keys], v, "_c",
        f"_run + max(CASE WHEN _last THEN _from END) OVER ({slot_of}) AS _cum",
        *[f"max(CASE WHEN _last THEN {t} END) OVER ({slot_of}) AS {t}" for t in totals],
    )
    ranks = {n: f"(CAST(_n - 1 AS DOUBLE) * {float(p)!r})" for n, p in probs.items()}
    picked = [
        f"max(CASE WHEN {v} IS NOT NULL AND _cum - _c <= {f}({r}) AND {f}({r}) < _cum THEN {v} END) AS _{n}_{end}"
        for n, r in ranks.items() for end, f in (("lo", "floor"), ("hi", "ceil"))
    ]
    out = ranked.groupBy(*keys).agg(*[F.expr(f"max({t}) AS {t}") for t in totals], *map(F.expr, picked))
    out = out.selectExpr("*", *[f"{r} - floor({r}) AS _{n}_d" for n, r in ranks.items()])
    counts = []
    if values_as:
        counts.append(f"_n AS `{values_as}`")
    if rows_as:
        counts.append(f"_rows AS `{rows_as}`")
    # Reference engine: lo * (1 - d) + hi * d, contracted to one fused multiply-add.
    return out.selectExpr(
        *[f"`{k}`" for k in keys],
        *[
            f"CASE WHEN _{n}_d = 0 THEN _{n}_lo "
            f"ELSE {fma_sql(f'_{n}_lo', f'1.0D - _{n}_d', f'_{n}_hi * _{n}_d')} END AS `{n}`"
            for n in probs
        ],
        *counts,
        *[f"`{n}`" for n in counts_if],
    )
