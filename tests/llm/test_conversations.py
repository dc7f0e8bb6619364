"""The operators on conversations against brute force, on odd rows and on the small tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import sys
import zlib
from functools import cache

import duckdb
import pytest

from keelson.llm import prefix_trie, q_llm, structure_repair

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, marker string, first_at string, n string, symbol string"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def odd_turns(spark, seed=3, n=400):
    """Nulls in every column, empty and very long texts, ties, repeated rows, gaps, extra and clashing columns."""
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "umbrella", "Assistant"]
    texts = ["", " \t", "a.", "b", "c!\n", "é?", None, "long " * 3000 + ".", "x\x85", "? no"]
    rows = [(rng.choice([None, -20, -3, 0, 1, 2, 3, 20, 21, 39, 40, 47, 60, 61]), rng.choice([None, *range(-2, 6), 9]),
             rng.choices(roles, [6, 6, 3, 1, 1, 1, 1, 1])[0], rng.choice(texts), "m", "f", "n", "s") for _ in range(n)]
    return spark.createDataFrame(rows + rows[:20], TURNS)


def tables_of(spark):
    small = spark.read.parquet(f"{SF}/conversations.parquet")
    return [odd_turns(spark), small, small.limit(0)]


def rows_of(df, cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)


# ------------------------------------------------------- 11 structure repair


def brute_repair(rows):
    """Least (cost, audit) for rows (initial, must go, truncated): every edit tried, up to three inserts in a row."""
    sys.setrecursionlimit(20_000)

    @cache
    def best(i, last, inserted):
        ways = [(0, "")] if i == len(rows) and last in ("", "a") else []
        for x in {"": "su", "s": "u", "u": "a", "a": "u"}[last]:
            if x != "s" and inserted < 3:
                c, a = best(i, x, inserted + 1)
                ways.append((c + 2, "I" + a))
            if i < len(rows) and not rows[i][1]:
                c, a = best(i + 1, x, 0)
                if x != "s":
                    ways.append((c + 2 + rows[i][2], "R" + a))
                if rows[i][0] == x:
                    ways.append((c + rows[i][2], "K" + a))
        if i < len(rows):
            c, a = best(i + 1, last, 0)
            ways.append((c + 3, "D" + a))
        return min(ways, default=(10**9, ""))

    return best(0, "", 0)


def enumerate_repair(rows):
    """The same by listing every sequence of edits of a few rows."""
    legal = re.compile(r"(s?(ua)+)?")
    found = []
    for inserts in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
        options = [[("D", "", 3)] + ([] if gone else [("K", c, t), ("R", "u", 2 + t), ("R", "a", 2 + t)])
                   for c, gone, t in rows]
        for edits in itertools.product(*options):
            made = inserts[0] + "".join(e[1] + x for e, x in zip(edits, inserts[1:], strict=True))
            if legal.fullmatch(made):
                audit = "I" * len(inserts[0]) + "".join(e[0] + "I" * len(x) for e, x in zip(edits, inserts[1:], strict=True))
                found.append((sum(e[2] for e in edits) + 2 * sum(map(len, inserts)), audit))
    return min(found)


@pytest.mark.parametrize("block", [1, 2, 4, 5])
def test_block_tables_find_the_least_audit(block):
    made = structure_repair.Tables(block)
    rng = random.Random(block)
    for n in [0, 1, 2, 2, 3, 3] * 3:
        rows = [(rng.choice("suax"), rng.random() < 0.2, int(rng.random() < 0.3)) for _ in range(n)]
        symbols = bytes(0 if gone else 1 + 2 * "suax".index(c) + t for c, gone, t in rows)
        assert made.repair(symbols) == enumerate_repair(rows)


def test_block_tables_on_long_conversations():
    rng = random.Random(9)
    one, four = structure_repair.Tables(1), structure_repair.tables()
    for n in (17, 200, 5003):
        symbols = bytes(rng.choices(range(9), [2, 1, 1, 6, 2, 6, 2, 1, 1], k=n))
        assert four.repair(symbols) == one.repair(symbols)
    assert len(four.vectors) < 100


def brute_conversations(rows):
    groups = {}
    for conv_id, turn, role, text in rows:
        out = groups.setdefault(conv_id, [])
        hit = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit == 0:
            continue
        role = "user" if hit == 4 else role
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(turn, role, text)] * (2 if hit == 3 else 1)
    result = []
    for conv_id, out in groups.items():
        out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {t for t, _, _ in out if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        seen, kinds = set(), []
        for _, role, text in out:
            marks = WORD.findall(text)
            kinds.append("blank" if not marks else "duplicate" if (role, text) in seen else
                         "truncated" if marks[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in out]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        symbols = [(c, k in ("blank", "duplicate"), int(k == "truncated")) for c, k in zip(initials, kinds, strict=True)]
        cost, audit = brute_repair(tuple(symbols))
        left, at, last = [], 0, ""
        for letter in audit:
            fits = {"": "user", "s": "user", "a": "user", "u": "assistant"}[last]
            if letter == "I":
                left.append(f"{fits}:")
                last = fits[0]
                continue
            if letter != "D":
                role = fits if letter == "R" else out[at][1]
                left.append(f"{role}:{out[at][2]}")
                last = role[0]
            at += 1
        result.append((conv_id, gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost,
                       audit, hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(result, key=repr)


REPAIRED = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("which", [0, 1, 2])
def test_repair_matches_brute_force(spark, which):
    d = tables_of(spark)[which]
    want = brute_conversations([(r.conv_id, r.turn, r.role, r.text) for r in d.collect()])
    assert rows_of(structure_repair.repair(d, structure_repair.damage(d)), REPAIRED) == want


def test_repair_of_one_long_conversation(spark):
    d = spark.range(30_000).selectExpr(
        "7L as conv_id", "id as turn", "if(id % 3 = 0, 'user', if(id % 5 = 0, 'tool', 'assistant')) as role",
        "concat('row ', id % 20000, if(id % 7 = 0, '', '.')) as text")
    got = structure_repair.repair(d, structure_repair.damage(d)).collect()
    want = brute_conversations([(r.conv_id, r.turn, r.role, r.text) for r in d.limit(400).collect()])
    assert len(got) == 1 and got[0].duplicate > 3_000
    few = d.where("turn < 400")
    assert rows_of(structure_repair.repair(few, structure_repair.damage(few)), REPAIRED) == want


def duck_rows(spark, tmp_path, df, sql, cols):
    path = str(tmp_path / "conversations.parquet")
    df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}).to_parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    return sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall(), key=repr)


def test_repair_sql_agrees_on_odd_rows(spark, tmp_path):
    d = odd_turns(spark, 5, 120)
    got = rows_of(structure_repair.repair(d, structure_repair.damage(d)), REPAIRED)
    assert got == duck_rows(spark, tmp_path, d, q_llm.ORACLES["op11_structure_repair"], REPAIRED)


# ------------------------------------------------------------- 13 prefix trie

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_trie(rows, rebuilt=True):
    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own.setdefault(conv_id, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members = {}
    for c, ts in own.items():
        if rebuilt:
            h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c > 0 else -1)
            ts = own.get(base, [])[:h] + ts[h:]
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append((c, d == len(ts)))
    out = []
    for path, found in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(q[:-1] == p for q in below if q) for p in below)
        saved = sum((len(members[p]) - 1) * len(re.findall(rb"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c, last in sorted(found) if last)
        up = min(members[path[:-1]])[0] if path else None
        out.append((min(found)[0], len(path), up, len(found), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def hot_turns(spark):
    """A hot first turn, many copies of one conversation, one that is part of another."""
    rows = []
    for c in range(90):
        first = "hello there" if c % 3 else f"turn {c % 4}"
        rest = [("assistant", "same words again"), ("user", "and on")] if c % 2 else [("assistant", f"own {c % 7}")] * (c % 5)
        rows += [(c * 20, i, r, t, "m", "f", "n", "s") for i, (r, t) in enumerate([("user", first), *rest])]
    return spark.createDataFrame(rows, TURNS)


@pytest.mark.parametrize("limit", [1, 3, 1024])
@pytest.mark.parametrize("which", [0, 1, 2, 3])
def test_trie_matches_brute_force(spark, which, limit):
    d = (odd_turns(spark, 4, 120), spark.read.parquet(f"{SF}/conversations.parquet"), hot_turns(spark).limit(0), hot_turns(spark))[which]
    want = brute_trie([(r.conv_id, r.turn, r.role, r.text) for r in d.collect()])
    assert rows_of(prefix_trie.trie(d, limit=limit), NODE) == want


def test_trie_without_families(spark):
    d = hot_turns(spark)
    want = brute_trie([(r.conv_id, r.turn, r.role, r.text) for r in d.collect()], rebuilt=False)
    assert rows_of(prefix_trie.trie(d, rebuilt=False, limit=5), NODE) == want


def test_trie_shards_across_arrow_batches(spark):
    d = hot_turns(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert rows_of(prefix_trie.trie(d, limit=20), NODE) == rows_of(prefix_trie.trie(d, limit=1000), NODE)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(q_llm.ARROW_ROWS))


def test_trie_sql_agrees_on_odd_rows(spark, tmp_path):
    d = odd_turns(spark, 6, 150)
    got = rows_of(prefix_trie.trie(d, limit=4), NODE)
    assert got == duck_rows(spark, tmp_path, d, q_llm.ORACLES["op13_prefix_trie"], NODE)
