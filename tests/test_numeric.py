"""Quantiles and rounding agree bit-for-bit with the reference SQL engine."""

from __future__ import annotations

import random
import re

import duckdb
from pyspark.sql import functions as F

from keelson.functions.numeric import interpolated_quantiles, round_half_away, round_half_even


def test_quantiles_match_duckdb_bitwise(spark):
    rnd = random.Random(7)
    data = []
    for g in range(300):
        for _ in range(rnd.randint(1, 40)):
            data.append((g, rnd.randint(-200000, 200000) / 60.0))
    df = spark.createDataFrame(data, "g int, x double")
    got = {
        r["g"]: (r["p50"], r["p90"], r["p75"])
        for r in interpolated_quantiles(df, ["g"], "x", {"p50": 0.5, "p90": 0.9, "p75": 0.75}).collect()
    }
    con = duckdb.connect()
    con.execute("CREATE TABLE t(g INTEGER, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", data)
    want = {
        g: (a, b, c)
        for g, a, b, c in con.execute(
            "SELECT g, quantile_cont(x, 0.5), quantile_cont(x, 0.9), quantile_cont(x, 0.75) FROM t GROUP BY g"
        ).fetchall()
    }
    assert got == want


def test_rounding_matches_duckdb(spark):
    rnd = random.Random(3)
    xs = [100.0 * s / o for o in range(1, 120) for s in range(0, o + 1, max(1, o // 7))]
    xs += [rnd.randint(-100000, 100000) / 60.0 for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select(round_half_away(F.col("x")), round_half_even(F.col("x"))).collect()
    con = duckdb.connect()
    want = con.execute(
        "SELECT list(round(x, 1)), list(round_even(x, 1)) FROM (SELECT unnest(?) AS x)", [xs]
    ).fetchone()
    assert [r[0] for r in got] == want[0]
    assert [r[1] for r in got] == want[1]


def test_quantiles_of_a_hot_group_are_selected_in_slots(spark):
    """A group of many distinct values, negative ones too: only the slots that hold the ranks are sorted."""
    rng = random.Random(11)
    values = [("hot", rng.choice([-1, 1]) * rng.expovariate(1 / 500)) for _ in range(60_000)]
    values += [("small", x) for x in (3.0, -2.5, 0.0)] + [("none", None)] * 4 + [(None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(values, "g string, x double")
    out = interpolated_quantiles(df, ["g"], "x", {"p50": 0.5, "p90": 0.9}, "n", "rows", {"big": "x > 100"})
    got = {r.g: r for r in out.collect()}
    con = duckdb.connect()
    frame = df.toPandas()  # noqa: F841 - read by the query
    want = con.sql(
        "SELECT g, quantile_cont(x, 0.5), quantile_cont(x, 0.9), count(x), count(*), count(*) FILTER (x > 100) FROM frame GROUP BY g"
    ).fetchall()
    assert len(want) == len(got) == 4
    for g, p50, p90, n, rows, big in want:
        assert (got[g].p50, got[g].p90, got[g].n, got[g].rows, got[g].big) == (p50, p90, n, rows, big)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    by_value = [line for line in plan.splitlines() if "windowspecdefinition" in line and re.search(r"x#\d+ ASC", line)]
    assert by_value and all(re.search(r"windowspecdefinition\(g#\d+, _slot#", line) for line in by_value)
