"""Each operator against brute force, on odd rows and on the small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keelson.llm import (
    exact_topk, html_extract, language_id, mixing, packing, q_llm, quality_rules, sharding, simhash, suffix_dedup,
    token_counts,
)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, copy string, kept string"
ODD = ["", " ", "\n \t", "é", "a", "The cat.  sat\t\n\n on", "x" * 5000, "a " * 3000, "漢字 😀 \x1c \x85 b",
       "<|endoftext|> and <|startoftext|>", "It's Σ ΑΣ İ 12 ### ,,,", None]


def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra and clashing columns."""
    rng = random.Random(1)
    rows = [(i % 9 if i % 7 else None, t, rng.choice(["en", None]), rng.choice(["s", "t", None]), None, "c", "k")
            for i, t in enumerate(ODD * 2)]
    return spark.createDataFrame(rows + rows[:5], DOCS)


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)


def both(spark):
    return [odd_docs(spark), docs(spark), docs(spark).limit(0)]


# ------------------------------------------------------------------ 1 mixing


def brute_copies(rows, weights=None):
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").encode())
    weight = {s: (float(n) ** mixing.FLATTEN if weights is None else weights.get(s, 0.0)) for s, n in size.items()}
    out = []
    for i, t, s in rows:
        mean = sum(size.values()) * weight[s] / sum(weight.values()) / size[s] if size[s] else 1.0
        draws = max(1, math.ceil(mean / 8))
        ident = f"mix-1|{'-' if i is None else i}|{hashlib.md5((t or '').encode()).hexdigest()}"
        n = 0
        for j in range(1, draws + 1):
            u = int(hashlib.md5(f"{ident}|{j}".encode()).hexdigest()[:13], 16) / 2**52
            p = c = math.exp(-mean / draws)
            k = 0
            while c <= u:
                k += 1
                p *= mean / draws / k
                c += p
            n += k
        out += [(i, s, c, n) for c in range(n)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("which", [0, 1, 2])
def test_mixing_matches_brute_force(spark, which):
    d = both(spark)[which]
    want = brute_copies([(r.doc_id, r.text, r.source) for r in d.collect()])
    mixed = mixing.mix(d)
    assert rows_of(mixed, "doc_id", "source", "copy", "n_copies") == want
    assert set(d.columns) <= set(mixed.columns)


def test_mixing_given_weights_and_large_means(spark):
    d = docs(spark)
    weights = {"src0": 5.0, "src1": 1.0}
    table = spark.createDataFrame(list(weights.items()), "source string, weight double")
    want = brute_copies([(r.doc_id, r.text, r.source) for r in d.collect()], weights)
    assert rows_of(mixing.mix(d, table), "doc_id", "source", "copy", "n_copies") == want
    assert max(w[3] for w in want) > 8


# ------------------------------------------------------------ 2 token counts


@pytest.mark.parametrize("which", [0, 1, 2])
def test_token_counts_match_the_library(spark, which):
    d = both(spark)[which]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(
        ((r.doc_id, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids))
         for r in d.collect()), key=repr)
    assert rows_of(token_counts.count_tokens(d, ["doc_id"]), "doc_id", "n_bytes", "n_tokens") == want


def test_frequent_pieces_come_from_every_task(spark):
    rows = [(i, "left " * 50 if i < 50 else "right\n" * 50) for i in range(100)] + [(100, " ".join(f"w{i}" for i in range(500)))]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(4, "doc_id")
    table = token_counts.frequent_table(d, "text", token_counts.VOCABULARY, size=20)
    assert {" left", "right", "\n"} <= table.keys() and len(table) <= 20
    tok = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    assert all(n == len(tok.encode(p, add_special_tokens=False).ids) for p, n in table.items())
    assert token_counts.frequent_table(d.limit(0), "text", token_counts.VOCABULARY) == {}


def test_bounded_counter_keeps_what_is_frequent():
    rng = random.Random(4)
    frequent, true = token_counts.Frequent(30), Counter()
    for _ in range(400):
        words = [f"x{rng.randint(0, 3000)}" for _ in range(40)] + ["hot"] * 5 + ["warm"] * 2
        true.update(" " + w for w in words[1:])
        frequent.add(" ".join(words))
    found = frequent.found()
    assert len(found) <= 30 and {" hot", " warm"} <= found.keys()
    assert all(n <= true[w] for w, n in found.items())


CLASHING = ["draws", "cdf", "mean", "one", "__source", "__rated", "__ident", "__c0", "__text", "Copy", "n_words", "kept",
            "N_BYTES", "n_tokens", "bytes", "weight", "rate"]


def test_extra_columns_of_internal_names(spark):
    d = docs(spark).withColumns({c: F.lit(c) for c in CLASHING})
    mixed = mixing.mix(d)
    assert [c for c in mixed.columns if c not in ("copy", "n_copies", "shuffle_key")] == [c for c in d.columns if c != "Copy"]
    assert rows_of(mixed, "doc_id", "copy") == rows_of(mixing.mix(docs(spark)), "doc_id", "copy")
    assert {tuple(r) for r in mixed.select("cdf", "__c0", "mean").distinct().collect()} == {("cdf", "__c0", "mean")}
    counted = token_counts.count_tokens(d, d.columns)
    plain = token_counts.count_tokens(docs(spark), ["doc_id"])
    assert rows_of(counted, "doc_id", "n_bytes", "n_tokens") == rows_of(plain, "doc_id", "n_bytes", "n_tokens")
    assert counted.first()["__text"] == "__text"
    stats = quality_rules.quality_stats(d, d.columns)
    assert rows_of(stats, "doc_id", "n_words", "kept") == rows_of(
        quality_rules.quality_stats(docs(spark), ["doc_id"]), "doc_id", "n_words", "kept")
    assert stats.first()["__text"] == "__text"


def test_pieces_and_cache_on_random_white_space():
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\t", " ", "a", "B", "é", "é", "Σ", "1", "23", "!", "'s", "<|endoftext|>", "\x1c",
             "漢", "😀", "İ", "\r\n", "...", "́", "\x85", "ß", "text|>", "foo.", "Bar,"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    for vocabulary, lower in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        ids = packing.worker(vocabulary, lower)
        want = [e.ids for e in ids.tokenizer.encode_batch(texts, add_special_tokens=False)]
        if lower:
            assert [np.frombuffer(b, "<u4").tolist() for b in packing.encode(texts, ids)] == want
        else:
            assert token_counts.count(texts, {"a": 1}, ids) == [len(w) for w in want]


# ----------------------------------------------------------------- 3 simhash


def brute_simhash(rows):
    prints = []
    for _, t in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        grams = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    uniq = sorted(set(prints))
    root = {f: f for f in uniq}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(uniq):
        for b in uniq[i + 1 :]:
            if bin(a ^ b).count("1") <= 3:
                root[find(b)] = find(a)
    least = {}
    for (i, _), f in zip(rows, prints, strict=True):
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    found = [(i, f"{f:016x}", least.get(find(f))) for (i, _), f in zip(rows, prints, strict=True)]
    return sorted(found, key=repr), len({find(f) for f in uniq})


@pytest.mark.parametrize("which", [0, 1, 2])
def test_simhash_matches_brute_force(spark, which):
    d = both(spark)[which]
    rows = [(r.doc_id, r.text) for r in d.collect()]
    want, groups = brute_simhash(rows)
    assert rows_of(simhash.near_duplicates(d), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.drop_near_duplicates(d)
    assert kept.columns == d.columns
    assert kept.count() == groups
    assert {r.doc_id for r in kept.collect()} - {None} <= {w[2] for w in want}


def test_simhash_near_copies_and_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_SPLIT", 4)
    rng = random.Random(3)
    base = " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 5) for _ in range(400)).split()
    rows = []
    for i in range(150):
        words = list(base if i % 3 else reversed(base))
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice("xyz")
        rows.append((i, " ".join(words)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = brute_simhash(rows)
    assert len({w[1] for w in want}) > len({w[2] for w in want}) > 1
    assert rows_of(simhash.near_duplicates(d), "doc_id", "fingerprint", "component_id") == want


def test_simhash_every_plan_of_thresholds_finds_every_link(spark):
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    fps = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for s in seeds for _ in range(25)})
    arr = np.array(fps, np.uint64)
    near = {(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 3}

    def closed(pairs):
        root = {f: f for f in fps}

        def find(f):
            while root[f] != f:
                f = root[f]
            return f

        for a, b in pairs:
            root[find(a)] = find(b)
        groups = {}
        for f in fps:
            groups.setdefault(find(f), set()).add(f)
        return sorted(map(sorted, groups.values()))

    frame = spark.createDataFrame([(int(x),) for x in arr.view(np.int64)], "fp long")
    assert sum(t for _, t in simhash.plan(arr, 10**6, 3)) >= 0
    for picks in ([0, 0, 0, 0], [1, 0, 0], [2, 0], [1, 1]):
        groups = simhash.group_bits(arr, len(picks))
        chosen = [(simhash._mask(g), t) for g, t in zip(groups, picks, strict=True)]
        found = simhash.links(simhash.signatures(frame, chosen), chosen, 3).collect()
        pairs = [tuple(int(v) for v in np.array([r.a, r.b], np.int64).view(np.uint64)) for r in found]
        assert all(bin(a ^ b).count("1") <= 3 for a, b in pairs)
        assert closed(pairs) == closed(near)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(30)] + [(130, 200), (200, 99)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 99 for i in [*range(100, 131), 200]}


# ---------------------------------------------------------------- 4 sharding


@pytest.mark.parametrize("which", [0, 1, 2])
def test_sharding_law_slots_and_inverse(spark, which):
    d = both(spark)[which]
    got = sharding.assign(d).collect()
    want = sorted(((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode()))
                   for r in d.collect()), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == want
    n = len(want)
    assert sorted(r.row_number for r in got) == list(range(n))
    by_shard = Counter(r.shard for r in got)
    if n:
        assert max(by_shard.values()) - min([by_shard[s] for s in range(40)]) <= 1
        assert sorted((r.shard, r.slot) for r in got) == sorted((s, i) for s, c in by_shard.items() for i in range(c))
        at = sharding.row_number_at(np.array([r.shard for r in got]), np.array([r.slot for r in got]), n, 40, 4)
        assert at.tolist() == [r.row_number for r in got]
        again = sharding.assign(d.repartition(7)).collect()
        assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_sharding_unfolds_many_equal_rows_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(sharding, "UNFOLD", 7)
    docs = spark.createDataFrame([(1, "same")] * 50 + [(None, None)] * 15 + [(2, "b")], "doc_id long, text string")
    rows = sharding.assign(docs, shards=4).collect()
    assert sorted(r.row_number for r in rows) == list(range(66))
    assert sorted(r.slot * 4 + r.shard for r in rows) == list(range(66))
    assert sum(r.doc_id == 1 for r in rows) == 50


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 40, 1000, 4097):
        y = sharding.permute(np.arange(n), n, 9)
        assert sorted(y.tolist()) == list(range(n))
        assert sharding.invert(y, n, 9).tolist() == list(range(n))


# ----------------------------------------------------------- 5 quality rules


def brute_quality(text):
    t = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)

    def covered(n):
        grams = [tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)]
        count, mark = Counter(grams), [False] * len(ws)
        for i, g in enumerate(grams):
            if count[g] > 1:
                mark[i : i + n] = [True] * n
        return mark

    chars = sum(map(len, ws))
    seen, dup, dup_chars = set(), 0, 0
    for line in t.split("\n"):
        in_line = re.findall(r"[^\x20\x09-\x0D]+", line)
        if in_line and line in seen:
            dup, dup_chars = dup + 1, dup_chars + sum(map(len, in_line))
        seen.add(line)
    repeat = sum(covered(8))
    failed = len(ws) < 20 or 100 * repeat > 30 * len(ws)
    worst = max(sum(len(w) for w, c in zip(ws, covered(n), strict=True) if c) / max(1, chars) / limit
                for n, limit in quality_rules.NGRAM_LIMITS.items())
    kept = not failed and worst <= 1 and dup_chars / max(1, chars) <= quality_rules.LINE_LIMIT
    return len(ws), chars, sum(t.count(c) for c in "#*$%&|<>"), dup, repeat, failed, kept


@pytest.mark.parametrize("which", [0, 1, 2])
def test_quality_rules_match_brute_force(spark, which):
    d = both(spark)[which]
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = sorted(((r.doc_id, *brute_quality(r.text)) for r in d.collect()), key=repr)
    assert rows_of(quality_rules.quality_stats(d, ["doc_id"]), "doc_id", *cols) == want
    kept = quality_rules.filter_documents(d)
    assert kept.columns == d.columns and kept.count() == sum(w[-1] for w in want)


def test_quality_rules_on_random_lines():
    rng = random.Random(5)
    parts = ["a ", "b ", "é\n", "c d ", "\n", "# ", " a b c d e f g h i ", "x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    got = quality_rules.measure([t.encode() for t in texts])
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert [tuple(got[c][i] for c in cols) for i in range(len(texts))] == [brute_quality(t) for t in texts]


def test_quality_rules_measure_a_batch_in_small_blocks():
    """A batch of 4 MB takes a few MB of numpy's memory at a time, and its rows are judged as one by one."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=700)).encode() for _ in range(1000)]
    column = pa.array([*texts, None], pa.binary())
    tracemalloc.start()
    got = quality_rules.measured(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    few = quality_rules.measure(texts[-3:] + [b""])
    assert all(np.array_equal(got[c][-4:], few[c]) for c in few)
    assert quality_rules.measured(pa.array([], pa.string())) == {}


# ------------------------------------------------------------ 6 html extract


def test_main_text_of_broken_and_odd_pages():
    page = ("<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li>"
            "<a href='/x>y'>menu</a></li></ul></nav><div class='ad'>buy, buy, buy</div><article><h1>Head</h1>"
            "<p><b>One&nbsp;&amp; two,\n three.<br><p>Four.</p><form>no<input></form><!-- gone --></article>"
            "<div id='comments'><p>I, too, think so.</p></div><footer>foot</footer>")
    assert html_extract.main_text(page) == "Head\nOne & two, three.\nFour."
    cases = {"": "", "<p>": "", "a<b": "a", "<p>x<p>y": "x\ny", "<!-- x": "", "<script>x": "", "</p></div>t": "t",
             "<p>&#x110000;&lt;</p>": "�<", "<div><p>hello, world.</div><p class=nav>n": "hello, world."}
    assert {k: html_extract.main_text(k) for k in cases} == cases
    deep = "<div>" * 3000 + "<p>word, word.</p>"
    assert html_extract.main_text(deep) == "word, word."
    assert html_extract.main_text("<p>" + "long, text. " * 50000).startswith("long, text. long")


def test_pages_match_an_independent_reading(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract(pages, ["page_id", "url"]).collect()}
    for r in pages.collect():
        body = re.sub(r"</?b>", "", r.html.split("<article>")[1].split("</article>")[0].replace("<br>", " "))
        parts = [" ".join(html.unescape(p).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id].text == "\n".join(p for p in parts if p)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    odd = spark.createDataFrame([(1, None, None), (None, "u", ""), (1, None, None)], "page_id long, url string, html string")
    assert [(r.text, r.n_chars) for r in html_extract.extract(odd, ["page_id", "url"]).collect()] == [("", 0)] * 3


def test_main_text_beside_the_best_container():
    long = "One clause, two clauses, three clauses, and the rest of a paragraph that goes on for a while. " * 3
    body, text = f"<p>{long}</p>" * 10, "\n".join([long.strip()] * 10)
    menu = "<div><a href=a>Home</a> <a href=b>News</a></div>"
    cases = {
        f"<article><h1>T</h1><div class=content>{body}</div><ul><li>a<li>b<li>c</ul></article>": f"T\n{text}\na\nb\nc",
        f"<article><section>{body}</section>loose<section><p>Short.</p></section>{menu}</article>": f"{text}\nloose\nShort.",
        f"{menu}<div><h2><a href=x>T</a></h2><section><div>{body}</div></section><div><p>Short</p></div></div><p>far</p>":
            f"T\n{text}\nShort",
        f"<main><h1>T</h1><article><p>In.</p><article>{body}</article><table><tr><td>1</table></article>{menu}"
        "<blockquote>Q</blockquote></main><p>Beside.</p>": f"T\nIn.\n{text}\n1\nQ\nBeside.",
        f"<article>{body}</article>{menu}<article><p>Other.</p></article>": f"{text}\nOther.",
    }
    assert {k: html_extract.main_text(k) for k in cases} == cases


def test_wrappers_named_like_boilerplate_keep_the_article():
    body = "<p>" + "One clause, two clauses, and the rest of a paragraph. " * 9 + "</p>"
    text = body[3:-4].strip()
    around = "<div class=sidebar><p>Beside, no doubt.</p></div><nav><p>Menu.</p></nav><div id=comments><p>I think so.</p></div>"
    wrappers = ["div class='layout has-sidebar'", "div class='content with-sidebar'", "div class=no-comments", "form action=x",
                "div class=side-by-side", "div class=menu-open", "div class=category-social", "div class='row sidebar'",
                "section id=header", "div role=search"]
    for w in wrappers:
        tag = w.split()[0]
        for held in (body, f"<article>{body}</article>", f"<main><div>{body}</div></main>"):
            page = f"<html><body><{w}>{held}{around}</{tag}<></body></html>".replace("<>", ">")
            assert html_extract.main_text(page) == text, page
    held = {
        f"<{w}><article><h1>T</h1>{body}</article></{w.split()[0]}>{around}": f"T\n{text}"
        for w in ("div class=comments", "aside", "header", "div style='display:none'", "div class=ad-slot")
    }
    held |= {
        "<div><p>Short, but it is the text.</p></div><div class=post-comments>" + body + "</div>": "Short, but it is the text.",
        f"<article>{body}</article><div class='cookie-banner'>{body}{body}</div><div class=site-footer><p>f.</p></div>": text,
        f"<article>{body}<form><p>Name, please.</p></form></article><form>{around}</form>": text,
        f"<article>{body}</article><div id=comments><article><p>So, so.</p></article></div>": text,
        f"<div>{body}</div><ol class=comments><article class='comment-body x'><p>So.</p></article><li><article class=comment>"
        "<p>No.</p></article></ol>": text,
    }
    assert {k: html_extract.main_text(k) for k in held} == held


# ------------------------------------------------------------ 7 suffix dedup


def brute_suffix(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        starts = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


COLS7 = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


@pytest.mark.parametrize("which", [0, 1, 2])
def test_suffix_dedup_matches_brute_force(spark, which):
    d = both(spark)[which]
    want = brute_suffix([(r.doc_id, r.text) for r in d.collect()], 400)
    assert rows_of(suffix_dedup.digests(d), *COLS7) == want
    left = suffix_dedup.remove_repeats(d)
    assert left.columns == d.columns and left.count() == len(want)


@pytest.mark.parametrize("length,hot,block", [(16, 20_000, 1 << 21), (24, 3, 2_000), (9, 1, 700), (19, 0, 1 << 21), (40, 20_000, 300)])
def test_suffix_dedup_short_strings(spark, monkeypatch, length, hot, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = random.Random(length)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(5, 200))) for _ in range(12)]
    rows = []
    for i in range(120):
        t = "".join(rng.choice(base)[rng.randint(0, 20) : rng.randint(20, 200)] if rng.random() < 0.6
                    else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 5)))
        rows.append((i, rng.choice(["", "a" * 100, "ab" * 40, None]) if rng.random() < 0.1 else t))
    rows += rows[:10]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(suffix_dedup.digests(d, length, hot=hot), *COLS7) == brute_suffix(rows, length)


# -------------------------------------------------------------- 8 exact top-k


def brute_top(rows, every, k=5):
    clean = sorted({(i, tuple(math.floor(256 * float(c)) for c in v)) for i, v in rows
                    if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)})
    out = []
    for i, v in clean:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in clean if (j, w) != (i, v))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out, key=repr)


def test_exact_topk_matches_brute_force(spark):
    d = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = exact_topk.top_k(d, F.col("vec_id") % 50 == 0)
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == brute_top([(r.vec_id, r.embedding) for r in d.collect()], 50)
    assert exact_topk.top_k(d.limit(0), F.lit(True)).count() == 0


def test_exact_topk_odd_vectors_small_blocks(spark):
    rng = random.Random(6)
    odd = [None, [float("nan"), 1.0], [1.0, None], [float("inf")], [], [1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [0.0, 0.0], [0.5]]
    rows = [(rng.choice([None, *range(400)]), rng.choice([*odd, [rng.random() - 0.5 for _ in range(3)]])) for _ in range(500)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = exact_topk.top_k(d, F.col("vec_id") % 5 == 0, block=7, slice_rows=40, seed_rows=10, pivots=9)
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == brute_top(rows, 5)


# -------------------------------------------------------------- 9 language id


def test_language_id_held_out_accuracy_and_odd_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(d)
    got = language_id.identify(d, model).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97
    odd = odd_docs(spark)
    rows = language_id.identify(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    blank = language_id.identify(spark.createDataFrame([(1, None), (2, "12 ²!"), (3, "")], "doc_id long, text string"), model)
    assert {(r.lang_pred, r.score) for r in blank.collect()} == {("und", 0.0)}
    empty = language_id.fit(d.limit(0))
    assert {r.lang_pred for r in language_id.identify(odd, empty).collect()} == {"und"}


def brute_language(train, text):
    """The backoff read plainly: dictionaries of counts, one word after the other."""
    langs = sorted({lang for lang, _ in train})
    counts = {n: {lang: Counter() for lang in langs} for n in (0, *language_id.LENGTHS)}
    for lang, t in train:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            counts[0][lang][w] += 1
            for n in language_id.LENGTHS:
                counts[n][lang].update(f" {w} "[i : i + n] for i in range(len(w) + 3 - n))
    every = {n: set().union(*by.values()) for n, by in counts.items()}

    def log_share(n, lang, entry):
        return math.log((counts[n][lang][entry] + 0.5) / (sum(counts[n][lang].values()) + 0.5 * len(every[n])))

    total = dict.fromkeys(langs, 0.0)
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        used, entries = 0, [w] if w in every[0] else []
        while not entries and used < len(language_id.LENGTHS):
            n = language_id.LENGTHS[used]
            entries = [g for i in range(len(w) + 3 - n) if (g := f" {w} "[i : i + n]) in every[n]]
            used += 1
        n = language_id.LENGTHS[used - 1] if used else 0
        for lang in langs:
            total[lang] += sum(log_share(n, lang, e) for e in entries) / max(1, len(entries))
    best = max(langs, key=lambda lang: total[lang])
    return best, 1 / sum(math.exp(x - total[best]) for x in total.values())


@pytest.mark.parametrize("plain", [0, language_id.PLAIN_SCORES])
def test_language_id_matches_brute_force(spark, monkeypatch, plain):
    monkeypatch.setattr(language_id, "PLAIN_SCORES", plain)
    rng = random.Random(3)
    letters = {"common": "abcdefgh", "rare": "efghijkl", "third": "ghéèüß"}

    def text(lang, n):
        return " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))

    rows = [(i, text("common", 60), "common") for i in range(100)] + [(1000 + i, text("rare", 9), "rare") for i in range(8)]
    rows += [(2000 + i, text("third", 30), "third") for i in range(20)] + [(3000, None, "rare"), (3001, "xyz", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(d)
    train = [(lang, t) for i, t, lang in rows if t and lang and zlib.crc32(str(i).encode()) % 4 != 2]
    words = {w for _, t in train for w in t.lower().split()}
    assert model.index[0].keys() == words  # every word of the sample is kept
    asked = [(i, text(rng.choice(list(letters)), rng.randint(1, 12)) + rng.choice(["", " zzz", " abcdefghij hgf"])) for i in range(60)]
    got = language_id.identify(spark.createDataFrame(asked, "doc_id long, text string"), model)
    for r in got.collect():
        lang, score = brute_language(train, dict(asked)[r.doc_id])
        assert (r.lang_pred, r.score) == (lang, pytest.approx(score, rel=1e-9))


def test_language_id_sample_is_bounded_by_rows_and_bytes(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE", 50)
    d = spark.range(4000).selectExpr("id AS doc_id", "concat('w', translate(cast(id AS string), '0123456789', 'abcdefghij')) AS text", "'x' AS lang")
    assert 15 < len(language_id.fit(d).index[0]) < 100
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 100)
    assert len(language_id.fit(d).index[0]) < 50


# ----------------------------------------------------------------- 10 packing


@pytest.mark.parametrize("which", [0, 1, 2])
def test_packing_round_trip(spark, which):
    d = both(spark)[which]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack(d, with_ids=True).collect()
    sequences = {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    want = sorted(([r.doc_id, [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]] for r in d.collect()), key=repr)
    docs_back = Counter()
    for i, ids in want:
        for a in range(0, len(ids), 2048):
            docs_back[i, a, zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.ids_crc32, r.doc_tokens) for r in got) == docs_back
    if which == 1:
        total = sum(r.length for r in got)
        assert len(sequences) * 2048 - total < 2 * 2048


def test_bin_slack_plan_fills_windows():
    rng = random.Random(7)
    counts = Counter(min(100, int(rng.lognormvariate(3, 1)) + 1) for _ in range(3000))
    used = packing.fill(dict(counts), 100)
    assert sum(n * k for n, k in used.items()) == 100 and all(k <= counts[n] for n, k in used.items())
    plan = packing.plan(dict(counts), 100)
    bins = max(int(row[2]) for rows in plan.values() for row in rows) + 1
    assert bins <= math.ceil(sum(n * c for n, c in counts.items()) / 100) + 2
    assert packing.plan({}, 100) == {}


# ------------------------------------------------------------------- pipeline


def test_pipeline_stages_match_brute_force(spark):
    import corpus_pipeline

    d = docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in d.collect()]
        out = stage(spark, d, SF)
        rows = [r.asDict() for r in out.collect()]
        if name == "quality_rules":
            assert sorted(map(repr, rows)) == sorted(repr(r) for r in before if brute_quality(r["text"])[-1])
        elif name == "simhash_near_dedup":
            groups = {c for _, _, c in brute_simhash([(r["doc_id"], r["text"]) for r in before])[0]}
            assert sorted(map(repr, rows)) == sorted(repr(r) for r in before if r["doc_id"] in groups)
        elif name == "suffix_array_dedup":
            gone = {r[0]: r[2] for r in brute_suffix([(r["doc_id"], r["text"]) for r in before], 400)}
            old = {r["doc_id"]: len(r["text"].encode()) for r in before}
            for r in rows:
                assert 0 <= old[r["doc_id"]] - gone[r["doc_id"]] - len(r["text"].encode()) < 4
                assert r["n_chars"] == len(r["text"])
        elif name == "mixing":
            want = Counter(c[0] for c in brute_copies([(r["doc_id"], r["text"], r["source"]) for r in before]))
            assert Counter(r["doc_id"] for r in rows) == want
        else:
            assert Counter(r["doc_id"] for r in rows if r["start"] == 0) == Counter(r["doc_id"] for r in before)
            break
        assert out.columns == d.columns
        d = spark.createDataFrame(rows, d.schema)
    assert corpus_pipeline.run(spark, SF).count() == len(rows)


def test_registered_queries():
    assert len(q_llm.QUERIES) == 13 and set(q_llm.ORACLES) <= set(q_llm.QUERIES)
