"""Benchmark decontamination (operator 9): n-gram seeds, then Smith-Waterman alignment of words.

Benchmark items are taken in blocks of bounded size. For a block, one pass over the texts finds the word n-grams of its items in
each document. Where enough n-grams of an item lie near each other, words are aligned with the item's words, however many
documents hold these n-grams: copies of a leak must not hide each other. Before an alignment, the words that both sides hold
bound its score, so common n-grams cost little.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import table

#: Words in a seed.
SEED = 3
#: Seeds of one item near each other that a passage needs; part of the item's best possible score that an alignment needs.
LEAST_SEEDS, LEAST_SCORE = 2, 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Items in a block: what is sent to the executors at once is bounded by this.
BLOCK = 20_000

_words = re.compile(r"\w+").findall


def item_words(text: str | None) -> list[str]:
    return _words(text.lower()) if text else []


class Items:
    """A block of items as word numbers, with their n-grams."""

    def __init__(self, rows: list[tuple[int, str]], n: int = SEED):
        self.n, self.number, self.ids, self.seqs = n, {}, [], []
        for item_id, text in rows:
            words = item_words(text)
            if words:
                self.ids.append(item_id)
                self.seqs.append(np.array([self.number.setdefault(w, len(self.number)) for w in words], np.int64))
        self.base = max(2, len(self.number))
        grams = [self.codes(s) if len(s) >= n else np.empty(0, np.uint64) for s in self.seqs]
        self.grams = np.unique(np.concatenate(grams)) if grams else np.empty(0, np.uint64)
        #: Of each item the numbers of its n-grams by place; all places sorted by n-gram, those of n-gram c from start[c] on.
        self.own = [np.searchsorted(self.grams, g) for g in grams]
        every = np.concatenate(self.own) if grams else np.empty(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.start = np.searchsorted(every[order], np.arange(len(self.grams) + 1))
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.least = [max(1, len(s) - n + 1) for s in self.seqs]
        self.words = [np.unique(s, return_counts=True) for s in self.seqs]

    def codes(self, seq: np.ndarray) -> np.ndarray:
        """One number for each n-gram; mixed modulo 2^64, so a false match is possible in principle and ends at the alignment."""
        m = len(seq) - self.n + 1
        out = np.zeros(m, np.uint64)
        for k in range(self.n):
            out = out * np.uint64(self.base) + seq[k : k + m].astype(np.uint64)
        return out

    def document(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers (-1: in no item), positions of n-grams that items have, and the numbers of these n-grams."""
        words = item_words(text)
        if len(words) < self.n or not len(self.grams):
            return (none := np.empty(0, np.int64)), none, none
        seq = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        known = seq >= 0
        m = len(seq) - self.n + 1
        full = known[:m].copy()
        for k in range(1, self.n):
            full &= known[k : k + m]
        pos = np.flatnonzero(full)
        if not len(pos):
            return seq, pos, pos
        code = self.codes(seq)[pos]
        found = np.searchsorted(self.grams, code)
        found[found == len(self.grams)] = 0
        hit = self.grams[found] == code
        return seq, pos[hit], found[hit]

    def may_leak(self, seq: np.ndarray, code: np.ndarray, least_seeds: int, least_score: float) -> list[int]:
        """The items with n-grams at enough places and with words enough for least_score; each place of an item has one n-gram."""
        some = np.unique(code)
        begin, size = self.start[some], self.start[some + 1] - self.start[some]
        at = np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)
        items, places = np.unique(self.item[at], return_counts=True)
        have = np.bincount(seq[seq >= 0], minlength=self.base)
        out = []
        for item, n in zip(items.tolist(), places.tolist(), strict=True):
            if n >= min(least_seeds, self.least[item]):
                words, need = self.words[item]
                if np.minimum(have[words], need).sum() >= least_score * len(self.seqs[item]):
                    out.append(item)
        return out

    def common(self, item: int, part: np.ndarray) -> int:
        """How many of the item's words a part of a text can match, whatever their order."""
        words, need = self.words[item]
        found = np.searchsorted(words, part)
        found[found == len(words)] = 0
        return int(np.minimum(np.bincount(found[words[found] == part], minlength=len(words)), need).sum())


def align(item: np.ndarray, doc: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman: best local score and the position after its end in doc. Row by row; gaps along the row by a running maximum."""
    m = len(doc)
    ramp = np.arange(m + 1) * -GAP
    row, best, end = np.zeros(m + 1, np.int64), 0, 0
    for w in item:
        new = np.zeros(m + 1, np.int64)
        np.maximum(row[:-1] + np.where(doc == w, MATCH, MISMATCH), row[1:] + GAP, out=new[1:])
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + ramp) - ramp
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
    return best, end


def scan(items: Items, seq: np.ndarray, pos: np.ndarray, code: np.ndarray, least_seeds: int, least_score: float) -> list[tuple]:
    """(item_id, score, start_word, end_word, seeds) for each item that a text leaks, the best passage of each; seq, pos, code as document() has them."""
    if not len(code):
        return []
    out = []
    order = np.argsort(code, kind="stable")
    by_code, by_pos = code[order], pos[order]
    for item in items.may_leak(seq, code, least_seeds, least_score):
        own, grams = items.seqs[item], items.own[item]
        low, high = np.searchsorted(by_code, grams), np.searchsorted(by_code, grams, "right")
        hits = sorted((p, at) for at, (i, j) in enumerate(zip(low.tolist(), high.tolist(), strict=True)) for p in by_pos[i:j].tolist())
        slack = 4 + len(own) // 3
        spans: list[list] = []
        for p, at in hits:
            a, b = max(0, p - at - slack), min(len(seq), p - at + len(own) + slack)
            if spans and a <= spans[-1][1] and b - spans[-1][0] < 4 * len(own) + 4 * slack:
                spans[-1][0], spans[-1][1] = min(a, spans[-1][0]), max(b, spans[-1][1])
            else:
                spans.append([a, b])
        best = None
        for a, b in spans:
            # seeds of a passage at a span's edge may have opened the next span; they count in both
            seeds = hits[bisect_left(hits, (a, 0)) : bisect_left(hits, (b, 0))]
            if len({at for _, at in seeds}) < min(least_seeds, items.least[item]) or items.common(item, seq[a:b]) < least_score * len(own):
                continue
            top, end = align(own, seq[a:b])
            score = top / (MATCH * len(own))
            if score >= least_score and (best is None or score > best[1]):
                _, back = align(own[::-1], seq[a : a + end][::-1])
                best = (items.ids[item], score, a + end - back, a + end, len(seeds))
        if best:
            out.append(best)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = SEED, least_seeds: int = LEAST_SEEDS, least_score: float = LEAST_SCORE, block: int = BLOCK) -> DataFrame:
    """Benchmark items found in docs(doc_id, text): (doc_id, item_id, score, start_word, end_word, n_seeds), one row for each pair.

    benchmark(item_id, text). score is the best local alignment over the best possible one. Words are runs of letters, digits
    and `_` in lower case. Null, empty and blank texts on either side leak nothing; items of fewer than n words have no seed and
    are not found. Repeated document rows give repeated rows; of repeated item ids each row is an item. Empty tables give an
    empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, start_word long, end_word long, n_seeds long"
    out = spark.createDataFrame([], schema)
    total = benchmark.count()
    blocks = -(-total // block)
    for i in range(blocks):
        part = benchmark if blocks == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)
        items = Items([(r.item_id, r.text) for r in part.select("item_id", "text").collect()], n)  # bounded by block
        if not len(items.grams):
            continue
        out = out.union(_leaks(texts, items, least_seeds, least_score, schema))
    return out


def _leaks(texts: DataFrame, items: Items, least_seeds: int, least_score: float, schema: str) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(items)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows += [(doc_id, *x) for x in scan(own, *own.document(text), least_seeds, least_score)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], names=arrow.names)

    return texts.mapInArrow(find, schema)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
