"""Language ID by word-first backoff.

A known word scores by its log frequency in each language; an unseen word falls
back to its character n-grams, first the longest length of which any is known,
then shorter ones. A document's language is that of the largest sum.

The model is fitted on a bounded, hash-drawn sample of labelled rows: about
:data:`SAMPLE` documents of each language and about :data:`SAMPLE_BYTES` of text, in whole
texts. All words and n-grams of the sample are kept, so the sample alone bounds
the model, which is broadcast. An entry holds the languages that it was seen in
and no others. Prediction sees the text alone.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
ties go to the language first in order; without labelled rows every text is
``und``; rows with a null id may be learned from like others; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import blocks, cut, maybe_broadcast, whole_texts

#: Labelled documents sampled for each language, and bytes of their texts (expected numbers, the lesser counts).
SAMPLE, SAMPLE_BYTES = 2_000, 1 << 24
#: Character n-gram lengths, longest first.
LENGTHS = (5, 4, 3, 2, 1)
UNKNOWN = "und"
#: Scores (entries times languages) up to which a length's are also laid out as a plain table, for speed alone.
PLAIN_SCORES = 1 << 23
#: Added to every count.
SMOOTH = 0.5
#: Words kept in a worker's cache before it starts anew.
CACHE_SIZE = 300_000

_WORD = re.compile(r"[^\W\d_]+")


def held_out(id_col: str) -> Column:
    """Rows never learned from: CRC32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def ngrams(word: str, n: int) -> list[str]:
    marked = f" {word} "
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Model:
    """Log frequencies of words (length 0) and n-grams in each language.

    ``counts`` has the columns length, gram, lang and n. Of an entry only the
    languages that it was seen in are held: what each gains over ``base``, the
    score of an entry that a language lacks.
    """

    def __init__(self, counts: pa.Table) -> None:
        counts = counts.sort_by([("length", "ascending"), ("gram", "ascending"), ("lang", "ascending")])
        self.languages: list[str] = sorted(pc.unique(counts["lang"]).to_pylist())
        names = pa.array(self.languages, pa.string())
        self.index: dict[int, dict[str, int]] = {}
        self.first: dict[int, np.ndarray] = {}
        self.lang: dict[int, np.ndarray] = {}
        self.gain: dict[int, np.ndarray] = {}
        self.base: dict[int, np.ndarray] = {}
        self.plain: dict[int, np.ndarray] = {}
        for length in (0, *LENGTHS):
            rows = counts.filter(pc.equal(counts["length"], length)).combine_chunks()
            grams = rows["gram"].to_pylist()
            new = np.array([i == 0 or g != grams[i - 1] for i, g in enumerate(grams)], bool)
            first = np.flatnonzero(new)
            lang = pc.index_in(rows["lang"], value_set=names).to_numpy().astype(np.int32)
            n = rows["n"].to_numpy().astype(float)
            total = np.bincount(lang, n, len(names)) + SMOOTH * len(first)
            self.index[length] = {grams[at]: i for i, at in enumerate(first.tolist())}
            self.first[length] = np.append(first, len(grams))
            self.lang[length], self.gain[length] = lang, np.log((n + SMOOTH) / SMOOTH)
            self.base[length] = np.log(SMOOTH / np.maximum(total, SMOOTH))
            if len(first) * len(names) <= PLAIN_SCORES:
                self.plain[length] = np.tile(self.base[length], (len(first), 1))
                self.plain[length][np.cumsum(new) - 1, lang] += self.gain[length]
        self.cache: dict[str, np.ndarray] = {}

    def _scores(self, length: int, entries: list[int]) -> np.ndarray:
        """Mean score of some entries in each language."""
        if length in self.plain:
            return self.plain[length][entries].mean(axis=0) if len(entries) > 1 else self.plain[length][entries[0]]
        first, out = self.first[length], self.base[length].copy()
        for i in entries:
            rows = slice(first[i], first[i + 1])
            out[self.lang[length][rows]] += self.gain[length][rows] / len(entries)
        return out

    def word(self, word: str) -> np.ndarray:
        """Scores of a lower-case word in each language."""
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) > CACHE_SIZE:
                self.cache.clear()
            got = self.cache[word] = self._word(word)
        return got

    def _word(self, word: str) -> np.ndarray:
        at = self.index[0].get(word)
        if at is not None:
            return self._scores(0, [at])
        for n in LENGTHS:
            known = [i for g in ngrams(word, n) if (i := self.index[n].get(g)) is not None]
            if known:
                return self._scores(n, known)
        return np.zeros(len(self.languages))

    def predict(self, text: str) -> tuple[str, float]:
        if not self.languages:
            return UNKNOWN, 0.0
        seen = Counter(w for w in _WORD.findall(text.lower()))
        letters = {w: n for w, n in seen.items() if any(map(str.isalpha, w))}
        if not letters:
            return UNKNOWN, 0.0
        table = np.array([self.word(w) for w in letters])
        total = np.array(list(letters.values()), float) @ table
        best = int(np.argmax(total))
        spread = np.exp(np.maximum(total - total[best], -700.0))
        return self.languages[best], float(spread[best] / spread.sum())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the labelled rows that aren't held out."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    size = F.sum(F.octet_length(text_col).cast("long"))
    sizes = labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n"), size.alias("bytes"))
    rates = sizes.select("lang", F.least(F.lit(SAMPLE) / F.col("n"), F.lit(SAMPLE_BYTES) / F.greatest("bytes", F.lit(1))).alias("rate"))
    rates = cut(rates)
    draw = F.pmod(F.xxhash64(F.lit("lang-sample"), F.col(id_col), F.col(text_col)), F.lit(1 << 30)) / float(1 << 30)
    drawn = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), draw.alias("draw"))
    sample = drawn.join(maybe_broadcast(rates, rates.count()), "lang").where("draw < rate").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            langs = batch.column(0).to_pylist()
            for first, texts in blocks(whole_texts(batch.column(1))):
                for lang, text in zip(langs[first:], texts, strict=False):
                    seen.setdefault(lang, Counter()).update(_WORD.findall(text.decode().lower()))
            out: Counter = Counter()
            for lang, words in seen.items():
                for word, count in words.items():
                    out[0, word, lang] += count
                    for n in LENGTHS:
                        for g in ngrams(word, n):
                            out[n, g, lang] += count
            if out:
                length, gram, lang = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(length, pa.int32()), pa.array(gram), pa.array(lang), pa.array(list(out.values()))],
                    ["length", "gram", "lang", "n"],
                )

    counts = sample.mapInArrow(run, "length int, gram string, lang string, n long")
    return Model(counts.groupBy("length", "gram", "lang").agg(F.sum("n").alias("n")).toArrow())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            found = [own.predict(t.decode()) for _, texts in blocks(whole_texts(batch.column(2))) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1),
                    pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                ],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    taken = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")
    )
    return taken.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
