"""The language model: closed forms, brute force where nothing is drawn, exact laws of seating, held-out perplexity."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from keelson.llm import hpy_lm
from keelson.llm.common import release

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, held string, block string, score string"


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]  # None: the end


def odd_docs(spark):
    rng = random.Random(8)
    texts = ["", None, " \t\n", "É é a", "a B b A", "x" * 9000, "the cat. " * 700, "\x85 \x1c y", "a a a a a b"]
    rows = [(i if i % 6 else None, rng.choice(texts) or " ".join(rng.choices("abcdefg", k=rng.randint(1, 40))), None, "h", "b", "s")
            for i in range(160)]
    return spark.createDataFrame(rows + rows[:8] + [(900 + i, t, "en", None, None, None) for i, t in enumerate(texts)], DOCS)


def brute(rows, context=(0.8, 1.0), strength=1.0):
    """Scores with one table for each cell and an undiscounted parent: nothing is drawn."""
    c, cells, train = Counter(), Counter(), [words(t) for i, t in rows if not held_out(i)]
    for ws in train:
        c.update(ws)
        cells.update(itertools.pairwise(["", *ws]))
    n, v = sum(c.values()), len(c)
    customers, tables, parent = Counter(), Counter(), Counter()
    for (u, w), k in cells.items():
        customers[u] += k
        tables[u] += 1
        parent[w] += 1
    d, s = context
    out = []
    for i, t in rows:
        ws = words(t)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        p = 0.0
        for u, w in itertools.pairwise(["", *ws]):
            below = (parent[w] + strength / (v + 1)) / (strength + len(cells))
            k = cells[u, w]
            p += math.log10((max(k - d, 0) * (k > 0) + (s + d * tables[u]) * below) / (s + customers[u]) if customers[u] else below)
        out.append((i, held_out(i), len(ws), sum(c[w] > 0 for w in ws), n, round(base, 6), round(p, 4)))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]


def got(df):
    return sorted(((*(r[c] for c in COLUMNS), round(r.base_score, 6), round(r.score, 4)) for r in df.collect()), key=repr)


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x[:5] == y[:5]
        assert x[5:] == pytest.approx(y[5:], rel=2e-5, abs=2e-4)


@pytest.mark.parametrize("settings", [{}, {"bucket_tokens": 300, "split": 5}])
def test_scores_match_brute_force_where_nothing_is_drawn(spark, settings):
    d = odd_docs(spark).repartition(3)
    want = brute([(r.doc_id, r.text) for r in d.collect()])
    close(got(hpy_lm.score(d, burn=0, samples=1, parent=(0.0, 1.0), **settings)), want)


def test_empty_and_untrained_tables(spark):
    d = odd_docs(spark)
    assert hpy_lm.score(d.limit(0)).collect() == []
    held = next(i for i in range(99) if held_out(i))
    alone = spark.createDataFrame([(held, "a b", None, None, None, None)], DOCS)
    assert got(hpy_lm.score(alone)) == [(held, True, 3, 0, 0, 0.0, 0.0)]


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = (" ".join(random.Random(1).choices(["Aa", "b", "cc\n", "é" * 9], k=4000))).encode()
    whole = hpy_lm.word_hashes([text, b"", b"z"])
    monkeypatch.setattr(hpy_lm, "PIECE", 100)
    pieces = hpy_lm.word_hashes([text, b"", b"z"])
    assert (whole[0] == pieces[0]).all() and whole[1].tolist() == pieces[1].tolist()


def tables_law(c, a, d):
    """Mean number of tables of ``c`` customers under the posterior, by all ways to divide them (Stirling recursion)."""
    ways = {1: 1.0}
    for n in range(1, c):
        new = defaultdict(float)
        for t, x in ways.items():
            new[t] += x * (n - d * t)
            new[t + 1] += x
        ways = new
    weight = {t: x * a**t * math.prod(1.0 for _ in range(t)) for t, x in ways.items()}
    # opening table t+1 in one restaurant weighs a each time: a is held fixed during a sweep
    return sum(t * x for t, x in weight.items()) / sum(weight.values())


@pytest.mark.parametrize(("c", "a", "d"), [(2, 0.7, 0.8), (5, 0.3, 0.5), (9, 2.0, 0.8)])
def test_gibbs_reaches_the_exact_law(c, a, d):
    rng = np.random.default_rng(1)
    n = 20_000
    t, sizes = hpy_lm.seat(np.full(n, c), np.full(n, a), d, rng)
    assert sizes.sum() == n * c and len(sizes) == t.sum()
    t, sizes = hpy_lm.gibbs(t, sizes, np.full(n, a), d, 60, rng)
    assert sizes.sum() == n * c and len(sizes) == t.sum() and (sizes > 0).all()
    assert t.mean() == pytest.approx(tables_law(c, a, d), rel=0.02)


def test_every_customer_moves_in_a_sweep():
    """Where new tables weigh all but everything, whoever moves ends alone: of every cell, small, grouped or huge."""
    c = np.array([2, 5, 63, 64, 65, 1000, 70_000])
    t, sizes = hpy_lm.gibbs(np.ones(len(c), np.int64), c, np.full(len(c), 1e15), 0.8, hpy_lm.MOVES, np.random.default_rng(4))
    assert t.tolist() == c.tolist() and (sizes == 1).all() and len(sizes) == c.sum()
    assert hpy_lm.gibbs(c[:0], c[:0], np.zeros(0), 0.8, 1, np.random.default_rng(4))[0].tolist() == []


@pytest.mark.parametrize("listed", [1 << 16, 0])
def test_grouped_moves_reach_the_law(monkeypatch, listed):
    monkeypatch.setattr(hpy_lm, "_ONE_BY_ONE", listed)
    rng, n, c, a = np.random.default_rng(6), 300 if listed else 80, 130, 4.0
    t, sizes = hpy_lm.seat(np.full(n, c), np.full(n, a), 0.8, rng)
    t, sizes = hpy_lm.gibbs(t, sizes, np.full(n, a), 0.8, 90, rng)
    assert (np.add.reduceat(sizes, np.cumsum(t) - t) == c).all() and (sizes > 0).all()
    assert t.mean() == pytest.approx(tables_law(c, a, 0.8), rel=0.06 if listed else 0.12)


def test_seating_many_customers_follows_the_sequential_law():
    c, a, d, n = 90, 1.5, 0.6, 3000
    law = {1: 1.0}
    for k in range(1, c):
        new = defaultdict(float)
        for t, x in law.items():
            p = a / (a + k - d * t)
            new[t] += x * (1 - p)
            new[t + 1] += x * p
        law = new
    t, sizes = hpy_lm.seat(np.array([c, 3] * n), np.full(2 * n, a), d, np.random.default_rng(2))
    assert t[::2].mean() == pytest.approx(sum(k * x for k, x in law.items()), rel=0.02)
    ends = np.cumsum(t)
    assert (np.add.reduceat(sizes, ends - t) == np.array([c, 3] * n)).all()


def test_probabilities_of_a_context_sum_to_one(spark):
    rng = random.Random(5)
    ids = [i for i in range(400) if not held_out(i)]
    rows = [(i, " ".join(rng.choices("abcd", [5, 2, 1, 1], k=12))) for i in ids]
    ask = [f"{u} {w}" for u in "abcd" for w in [*"abcd", "unseen", ""]]
    rows += list(zip([i for i in range(9999) if held_out(i)], ask, strict=False))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    fitted = hpy_lm.fit(d, bucket_tokens=2000, split=300)
    contexts = {r.bucket: hpy_lm.unpack(r.u) for r in fitted.state.collect()}
    asks = {(r.bucket, r.block): np.cumsum(hpy_lm.unpack(r.u)) for r in fitted.asks.collect()}
    cells = {}
    for r in fitted.answers(2).collect():
        for at, p in zip(asks[r.bucket, r.block].tolist(), hpy_lm.unpack(r.p).tolist(), strict=True):
            cells[r.bucket, at] = (int(contexts[r.bucket][at]), 10 ** (p / hpy_lm.LOG_STEPS))
    sums = Counter()
    for u, p in cells.values():
        sums[u] += p
    assert sum(abs(x - 1) < 1e-4 for x in sums.values()) >= 4


def test_each_averaged_state_follows_a_whole_sweep(spark):
    """Contexts that are spread move too, and the parent is seated anew: probabilities by the states themselves."""
    rng = random.Random(3)
    d = spark.createDataFrame([(i, " ".join(rng.choices("abcdefgh", [9, 5, 3, 2, 1, 1, 1, 1], k=15))) for i in range(300)], "doc_id long, text string")
    fitted = hpy_lm.fit(d, bucket_tokens=500, split=200)
    assert fitted.model.buckets > 2
    (d0, s0), (discount, strength) = hpy_lm.PARENT, hpy_lm.CONTEXT

    def now():
        """Of the model as it is: tables and probability of every cell; customers and tables of every word in the parent."""
        buckets = {r.bucket: r for r in fitted.state.collect()}
        told = {(r.bucket, r.parent): r for r in fitted.told.collect()}
        cells, parent, opened = {}, {}, Counter()
        for b, r in buckets.items():
            u, w, c, cu, t = (hpy_lm.unpack(r[x]).tolist() for x in ("u", "w", "c", "cu", "t"))
            for at, cell in enumerate(zip(u, w, c, cu, t, strict=True)):
                cells[b, at] = cell
                opened[cell[0]] += cell[4]
            for k in range(fitted.model.buckets):
                own = sorted({x for x in w if x % fitted.model.buckets == k})
                if own:
                    parent.update(zip(own, zip(*(hpy_lm.unpack(told[b, k][x]).tolist() for x in ("c0", "t0")), strict=True), strict=True))
        below = {w: (c0 - d0 * t0 + (s0 + d0 * fitted.tables) / (fitted.vocabulary + 1)) / (s0 + fitted.customers) for w, (c0, t0) in parent.items()}
        p = {k: (max(c - discount * t, 0) + (strength + discount * opened[u]) * below[w]) / (strength + cu) if cu else below[w]
             for k, (u, w, c, cu, t) in cells.items()}
        sums = Counter()
        for _, w, _, _, t in cells.values():
            sums[w] += t
        assert all(parent[w][0] == n for w, n in sums.items())
        return cells, p, parent

    asks = {(r.bucket, r.block): np.cumsum(hpy_lm.unpack(r.u)).tolist() for r in fitted.asks.collect()}
    first, p1, parent1 = now()
    given = fitted.answers(2).collect()
    second, p2, parent2 = now()
    moved = {u for k, (u, _, _, cu, t) in first.items() if cu >= 200 and second[k][4] != t}
    assert moved and len({b for (b, _), (u, *_) in first.items() if u in moved}) > 1
    assert parent1 != parent2
    for r in given:
        for at, p in zip(asks[r.bucket, r.block], hpy_lm.unpack(r.p).tolist(), strict=True):
            k = r.bucket, at
            assert p / hpy_lm.LOG_STEPS == pytest.approx(math.log10((p1[k] + p2[k]) / 2), abs=2e-6)
    again = hpy_lm.fit(d, bucket_tokens=500, split=200)
    more = {(r.bucket, r.block): r.p for r in again.answers(3).collect()}
    assert more != {(r.bucket, r.block): r.p for r in given}


def test_held_out_perplexity_beats_the_unigrams(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    scores = hpy_lm.score(d).cache()
    assert scores.count() == d.count()
    model, base = ({r.held_out: r.perplexity for r in hpy_lm.perplexity(scores, c).collect()} for c in ("score", "base_score"))
    assert model[True] < 0.7 * base[True] and model[False] < model[True]
    again = hpy_lm.score(d)
    assert got(again) == got(scores)


def test_release_reaches_frames_let_go_just_before(spark):
    """py4j tells the JVM within a second what Python let go; a collection before that keeps the frames' files."""
    for rows in range(3):
        df = spark.range(rows)
        held = spark._jvm.java.lang.ref.WeakReference(df._jdf)
        del df
        release(spark)
        assert held.get() is None
