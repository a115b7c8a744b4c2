"""SimHash near-duplicates (operator 2) by covering locality-sensitive hashing.

A pair of 64-bit fingerprints that differ in at most r = 3 bits must meet in one of 2^(r+1) - 1 = 15 tables: each bit position
gets a vector of 4 bits, table v keeps the positions whose vector has an odd product with v. The at most 3 vectors of the
differing positions span at most 3 of the 4 dimensions, so some v is orthogonal to all of them, and table v sees equal keys.
A bucket with very many fingerprints is refined by the same masks over the positions that its key leaves free.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, cut, in_python, lower_ascii, table, words_of

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Buckets with more distinct fingerprints are refined; a bucket refined twice has at most 2^8 or so.
BUCKET = 2048
#: Shingles whose bits are counted at once.
_BLOCK = 1 << 15


def fingerprint(text: str | None) -> int:
    """Bits set in more than half of the shingles' hashes; no words: 0. As a signed 64-bit integer."""
    words = words_of(lower_ascii(text)) if text else []
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [" ".join(words)]
    else:
        shingles = map(" ".join, zip(words, words[1:], words[2:]))
    h = np.fromiter(map(_hash, shingles), np.uint64, max(1, len(words) - SHINGLE + 1))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), _BLOCK):
        counts += np.unpackbits(h[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(h), bitorder="little")
    return int(bits.view(np.int64)[0])


def _hash(shingle: str, _h=xxhash.xxh64_intdigest) -> int:
    return _h(shingle, SEED)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Adds fp (long) to docs(.., text)."""
    return in_python(docs, ["text"], "fp long", lambda texts: ([fingerprint(t) for t in texts],))


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """The masks over some bit positions; vectors are dealt out in turn, so that masks keep about half of the positions."""
    size = (1 << (radius + 1)) - 1
    vector = {p: 1 + i % size for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (vector[p] & v).bit_count() % 2) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def level_masks(level: int) -> list[list[int]]:
    """For each mask of the level before (level 1: none), the masks that refine it, each holding its parent's positions too."""
    parents = [0]
    for _ in range(level - 1):
        parents = [p | m for p in parents for m in covering_masks([i for i in range(64) if not p >> i & 1])]
    return [[p | m for m in covering_masks([i for i in range(64) if not p >> i & 1])] for p in parents]


def _buckets(rows: DataFrame, level: int) -> DataFrame:
    """(fp, path) -> (fp, path, key), one row for each table."""
    masks = level_masks(level)
    tables = F.array(*[F.array(*[F.lit(_signed(m)) for m in own]) for own in masks]) if level < 3 else None
    n = len(masks[0])
    if tables is None:  # thousands of masks: looked up in a small table instead of a literal
        spark = rows.sparkSession
        flat = spark.createDataFrame([(i, j, _signed(m)) for i, own in enumerate(masks) for j, m in enumerate(own)], "path int, j int, mask long")
        return rows.join(F.broadcast(flat), "path").select("fp", (F.col("path") * n + F.col("j")).alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    own = F.element_at(tables, F.col("path") + 1)
    return rows.select("fp", "path", F.posexplode(own).alias("j", "mask")).select("fp", (F.col("path") * n + F.col("j")).alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


def _tie(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among some fingerprints: enough for components, never all pairs."""
    n = len(fps)
    left = np.ones(n, bool)
    out = []
    for start in range(n):
        if not left[start]:
            continue
        queue = [start]
        left[start] = False
        while queue:
            at = queue.pop()
            rest = np.flatnonzero(left)
            near = rest[np.bitwise_count(fps[rest] ^ fps[at]) <= radius]
            left[near] = False
            out += [(int(fps[at]), int(fps[x])) for x in near]
            queue += near.tolist()
    return out


def _tie_buckets(rows: DataFrame, radius: int) -> DataFrame:
    """Edges among the fingerprints of each bucket of rows(path, key, fp)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            edges = [e for fps in frame["fps"] for e in _tie(np.asarray(fps, np.int64), radius)]
            yield pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return rows.groupBy("path", "key").agg(F.collect_set("fp").alias("fps")).select("fps").mapInPandas(run, "a long, b long")


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): edges that connect exactly what links of at most `radius` bits connect, among distinct fps(fp)."""
    rows, out = fps.select("fp", F.lit(0).alias("path")), []
    for level in (1, 2, 3):
        spread = _buckets(rows, level)
        sizes = spread.groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1")
        fit = sizes if level == 3 else sizes.where(F.col("n") <= bucket)
        out.append(_tie_buckets(spread.join(fit.drop("n"), ["path", "key"]), radius))
        if level == 3:
            break
        hot = cut(sizes.where(F.col("n") > bucket).drop("n"))
        if hot.isEmpty():
            break
        rows = spread.join(hot, ["path", "key"]).select("fp", "path")
    edges = out[0]
    for more in out[1:]:
        edges = edges.union(more)
    return edges


def _groups(known: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id) for each fingerprint of known(doc_id, fp)."""
    fps = known.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(fps.select("fp"), radius))
    tied = found.join(fps, found.node == fps.fp).groupBy("root").agg(F.min("least").alias("component"))
    roots = found.join(tied, "root").select(F.col("node").alias("fp"), "component")
    return fps.join(roots, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Fingerprint and component of each row of docs(doc_id, text, ...).

    Adds fp (long), fingerprint (16 hex digits) and component_id: the smallest doc_id that links of at most `radius` differing
    bits reach. Null, empty and blank texts have fingerprint zero and are linked like any other. Repeated rows stay repeated; a
    null doc_id takes part in links but never becomes a component's id, unless the whole component has no id (then null). An
    empty table gives an empty table; other columns pass through.
    """
    marked = fingerprints(docs.drop("fingerprint", "component_id"))
    known = cut(marked.select("doc_id", "fp"))
    rows = known if {c for c in docs.columns} == {"doc_id", "text"} else marked
    out = rows.join(_groups(known, radius), "fp")
    return out.withColumn("fingerprint", F.lpad(F.lower(F.hex("fp")), 16, "0"))


def first_of_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest doc_id stays (of repeated rows one).

    Rows whose doc_id is null stay only if their component has no id at all.
    """
    known = cut(fingerprints(docs.select("doc_id", "text")).select("doc_id", "fp"))
    keep = _groups(known, radius).select(F.col("component_id").alias("doc_id")).distinct()  # a component's id is its smallest doc_id
    one = docs.join(keep, docs["doc_id"].eqNullSafe(keep["doc_id"]), "left_semi")
    return one.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first()))).where("_n = 1").drop("_n")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")
