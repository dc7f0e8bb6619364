"""The bucketed table: what a batch writes, killed and competing writers, replays, layouts, skipping, clean-up."""

from __future__ import annotations

import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keelson.session import scratch_path
from keelson.sources import bucketed
from keelson.sources.bucketed import BucketedTable
from keelson.streaming.upsert import run_table_stream

SCHEMA = "repo string, n long, seq long, state string"


def new_table(spark, schema=SCHEMA, buckets=8, **kw):
    path = scratch_path(spark, f"t-table-{uuid.uuid4().hex}")
    return BucketedTable(spark, path, **kw).create(StructType.fromDDL(schema), ["repo", "n"], ["seq"], buckets)


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def contents(df):
    return sorted(tuple(r) for r in df.collect())


def test_random_batches_equal_a_dictionary(spark):
    rng = random.Random(1)
    table, want, seq = new_table(spark, max_deltas=2), {}, 0
    for batch_id in range(6):
        rows = []
        for _ in range(rng.choice([0, 3, 60])):
            seq += 1
            at = seq if rng.random() < 0.8 else seq - 50  # some arrive late and lose
            rows.append((rng.choice(["a", "b", None]), rng.randint(0, 25), at * 1000 + rng.randint(0, 999), f"v{seq}"))
        for r in rows:
            if r[:2] not in want or want[r[:2]][2] < r[2]:
                want[r[:2]] = r
        table.upsert(frame(spark, rows), batch_id)
        assert sorted(map(repr, table.read().collect())) == sorted(repr(r) for r in frame(spark, list(want.values())).collect())


def test_a_batch_writes_only_its_buckets_and_rewrites_nothing(spark):
    table = new_table(spark)
    table.upsert(frame(spark, [("r", i, i, "old") for i in range(400)]))
    table.compact()
    before = table.manifest()
    assert len(before.files) == 8 and all(len(f) == 1 and f[0]["base"] for f in before.files.values())
    table.upsert(frame(spark, [("r", 7, 1000, "new"), ("r", 7, 999, "beaten")]))
    after = table.manifest()
    assert before.paths() < after.paths() and len(after.paths() - before.paths()) == 1
    touched = [b for b in after.files if after.files[b] != before.files[b]]
    assert len(touched) == 1 and after.files[touched[0]][-1]["rows"] == 1
    assert ("r", 7, 1000, "new") in contents(table.read()) and table.read().count() == 400
    # only the touched bucket is reduced again; the others are passed through
    plan = table.read()._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan


def test_only_buckets_with_many_deltas_are_compacted(spark):
    table = new_table(spark, max_deltas=2)
    table.upsert(frame(spark, [("r", i, i, "old") for i in range(100)]))
    table.compact()
    base = table.manifest()
    for k in range(3):
        table.upsert(frame(spark, [("r", 5, 1000 + k, f"v{k}")]))
    now = table.manifest()
    changed = [b for b in now.files if now.files[b] != base.files[b]]
    assert len(changed) == 1 and len(now.files[changed[0]]) == 1 and now.files[changed[0]][0]["base"]
    assert ("r", 5, 1002, "v2") in contents(table.read())


def test_a_killed_commit_leaves_the_old_version(spark, monkeypatch):
    table = new_table(spark)
    table.upsert(frame(spark, [("r", 1, 1, "kept")]), 0)
    version = table.versions()[-1]

    def killed(self, m):
        raise RuntimeError("executor and driver are gone")

    with monkeypatch.context() as patch:
        patch.setattr(BucketedTable, "_commit", killed)
        with pytest.raises(RuntimeError):
            table.upsert(frame(spark, [("r", 1, 2, "lost"), ("r", 2, 2, "lost")]), 1)
    assert table.versions()[-1] == version and contents(table.read()) == [("r", 1, 1, "kept")]
    table.upsert(frame(spark, [("r", 1, 2, "again")]), 1)
    assert contents(table.read()) == [("r", 1, 2, "again")]
    # the killed writer's files are old by now and go
    assert table.vacuum(keep=1, older_than_s=-60) >= 1
    assert contents(table.read()) == [("r", 1, 2, "again")]


def test_of_two_writers_the_second_adds_to_the_first(spark, monkeypatch):
    table = new_table(spark)
    other = BucketedTable(spark, table.path)
    commit = BucketedTable._commit
    raced = []

    def race(self, m):
        if not raced:
            raced.append(1)
            other.upsert(frame(spark, [("r", 1, 5, "other"), ("r", 2, 5, "other")]))
        commit(self, m)

    monkeypatch.setattr(BucketedTable, "_commit", race)
    table.upsert(frame(spark, [("r", 1, 6, "mine"), ("r", 3, 1, "mine")]))
    assert contents(table.read()) == [("r", 1, 6, "mine"), ("r", 2, 5, "other"), ("r", 3, 1, "mine")]
    assert table.versions() == [1, 2, 3]
    with pytest.raises(bucketed.CommitConflict):
        commit(table, table.manifest())


def test_a_replayed_batch_changes_nothing(spark):
    table = new_table(spark)
    batch = frame(spark, [("r", 1, 1, "a")])
    table.upsert(batch, 3, "feed")
    version = table.versions()
    table.upsert(frame(spark, [("r", 1, 9, "other rows under the same number")]), 3, "feed")
    assert table.versions() == version and contents(table.read()) == [("r", 1, 1, "a")]
    table.upsert(frame(spark, [("r", 1, 9, "b")]), 3, "another stream")
    assert contents(table.read()) == [("r", 1, 9, "b")]


def test_old_versions_go_and_the_last_stay_readable(spark):
    table = new_table(spark, max_deltas=1)
    for k in range(5):
        table.upsert(frame(spark, [("r", i, k * 100 + i, f"v{k}") for i in range(20)]))
    files = len(table.manifest().paths())
    want = contents(table.read())
    assert table.vacuum(keep=2) > 0
    assert len(table.versions()) == 2 and contents(table.read()) == want
    assert table.read(version=table.versions()[0]).count() == 20
    assert len(table.manifest().paths()) == files and table.vacuum(keep=2) == 0


def test_three_layouts_are_read_together_and_no_file_is_rewritten(spark):
    table = new_table(spark)
    table.upsert(frame(spark, [("r", 1, 1, "open"), ("r", 2, 1, "open")]))
    first = table.manifest().paths()
    second = "repo string, n long, seq long, state string, labels int"
    table.evolve(StructType.fromDDL(second), {"labels": 7})
    table.upsert(frame(spark, [("r", 2, 2, "closed", 1), ("r", 3, 2, "open", None)], second))
    third = "repo string, n long, seq long, status string, labels long"
    table.evolve(StructType.fromDDL(third), {}, {"status": "state"})
    table.upsert(frame(spark, [("r", 4, 3, "new", 5)], third))
    assert first < table.manifest().paths()
    assert [r.asDict() for r in table.read().orderBy("n").collect()] == [
        {"repo": "r", "n": 1, "seq": 1, "status": "open", "labels": 7},
        {"repo": "r", "n": 2, "seq": 2, "status": "closed", "labels": 1},
        {"repo": "r", "n": 3, "seq": 2, "status": "open", "labels": None},
        {"repo": "r", "n": 4, "seq": 3, "status": "new", "labels": 5},
    ]
    same = table.manifest().version
    table.evolve(StructType.fromDDL(third), {}, {"status": "state"})
    assert table.manifest().version == same
    table.compact()
    assert table.read().count() == 4


def test_bounds_open_few_files_and_lose_no_row(spark):
    start = datetime(2024, 1, 1)
    rows = [(f"repo{i % 40:02d}", i, i, start + timedelta(hours=i)) for i in range(4000)]
    table = new_table(spark, "repo string, n long, seq long, at timestamp", stats=["repo", "at"], max_rows=50)
    table.upsert(frame(spark, rows, "repo string, n long, seq long, at timestamp"))
    table.compact()
    every = sum(map(len, table.files_for().values()))
    one = table.files_for({"repo": ("repo07", "repo07"), "at": (start, start + timedelta(days=40))})
    assert every > 60 and sum(map(len, one.values())) < every / 4
    bounds = {"repo": ("repo07", "repo07"), "at": (start + timedelta(days=3), start + timedelta(days=40))}
    want = [r for r in rows if r[0] == "repo07" and bounds["at"][0] <= r[3] <= bounds["at"][1]]
    assert contents(table.read(bounds)) == sorted(want) and want
    # a newer version out of bounds replaces one in them
    table.upsert(frame(spark, [("repo07", 87, 99_999, start + timedelta(days=900))], "repo string, n long, seq long, at timestamp"))
    assert contents(table.read(bounds)) == sorted(r for r in want if r[1] != 87) and any(r[1] == 87 for r in want)


def test_a_stream_of_files_ends_in_the_batch_result(spark):
    folder = scratch_path(spark, f"t-feed-{uuid.uuid4().hex}")
    for k in range(4):
        frame(spark, [("r", i % (10 + k), 100 * k + i, f"v{k}") for i in range(30)]).coalesce(1).write.mode("append").parquet(folder)
    table = new_table(spark, max_deltas=1)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    got = contents(run_table_stream(stream, table, scratch_path(spark, f"t-ck-{uuid.uuid4().hex}"), "feed"))
    rows = spark.read.parquet(folder)
    want = rows.groupBy("repo", "n").agg(F.max_by(F.struct("seq", "state"), "seq").alias("w")).select("repo", "n", "w.*")
    assert got == contents(want) and table.manifest().applied == {"feed": 3}


def test_an_empty_table_has_its_columns(spark):
    table = new_table(spark)
    assert table.read().columns == ["repo", "n", "seq", "state"] and table.read().count() == 0
    assert BucketedTable(spark, table.path + "-none").manifest() is None
