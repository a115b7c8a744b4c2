"""Alignment of two tokenizers over a corpus (operator 11).

Each task encodes documents both ways and links tokens that end at the same byte. Its pair-document records, in order of the pair
with side B first, are radix-partitioned by the B id into compressed runs. Runs of a partition are merged by a heap, 64 at a time
and in as many passes as needed, which counts each pair; a B id's pairs stand together, so its highest count is known when they
have gone by, and then what its links add to each document is streamed back over the runs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from .bpe import PRE_TOKEN, byte_letters, load_spec
from .common import cut, discard, table

#: Partitions by the B id: its lowest bits.
BITS = 5
#: A run ends after so many tokens of side A or documents.
RUN_TOKENS, RUN_DOCS = 1 << 20, 1 << 16
#: Runs merged at once, and runs over which one copy of the counts streams.
FAN_IN = 64
#: Pairs in a frame of a run.
FRAME = 1 << 13
NEW = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Side:
    """The bytes of a vocabulary's entries, as lengths and one array, and what its ids look like in a list of groups."""

    def __init__(self, strings: list[bytes], last: str):
        if not all(strings):
            raise ValueError("a vocabulary entry is empty")
        self.size = np.array([len(s) for s in strings], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)
        # an id with a comma behind it, or with `last` where it ends its part of a group, in 8 bytes
        self.shown = np.array([[f"{i},", f"{i}{last}"] for i in range(len(strings))], "S8").view(np.uint64).reshape(-1)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.bytes[np.repeat(self.start[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class Pair:
    """Both tokenizers of a worker."""

    def __init__(self, spec: dict, model: bytes):
        import sentencepiece
        import tiktoken

        back = {c: b for b, c in enumerate(byte_letters())}
        special = {t["content"] for t in spec.get("added_tokens", ())}
        entries = {i: bytes(back[c] for c in s) for s, i in spec["model"]["vocab"].items() if s not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [spec["model"]["vocab"][x + y] for x, y in merges]
        if made != sorted(made):
            raise ValueError("ids don't rise with the ranks of merges")
        self.a = tiktoken.Encoding("a", pat_str=PRE_TOKEN, mergeable_ranks={s: i for i, s in entries.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        as_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.sides = Side([entries.get(i, b"\0") for i in range(max(entries) + 1)], "|"), Side(as_bytes, ";")

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        plain = self.a.encode_ordinary
        return [np.array(plain(" " + t), np.uint32) for t in texts], [np.array(x, np.uint32) for x in self.b.encode(texts, num_threads=1)]


_pairs: dict[str, Pair] = {}


def _pair(files) -> Pair:
    if files.value[2] not in _pairs:
        _pairs[files.value[2]] = Pair(*files.value[:2])
    return _pairs[files.value[2]]


# --- runs ---


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length as one compressed frame: the numbers of rows and of compressed bytes, then the bytes."""
    import zstandard

    data = zstandard.ZstdCompressor(level=1).compress(b"".join(c.tobytes() for c in columns))
    return len(columns[0]).to_bytes(4, "little") + len(data).to_bytes(4, "little") + data


def frames(blob: bytes, *types: type) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of each frame in turn."""
    import zstandard

    at, plain = 0, zstandard.ZstdDecompressor()
    while at < len(blob):
        n, size = int.from_bytes(blob[at : at + 4], "little"), int.from_bytes(blob[at + 4 : at + 8], "little")
        data = plain.decompress(blob[at + 8 : at + 8 + size])
        out, start = [], 0
        for t in types:
            out.append(np.frombuffer(data, t, n, start))
            start += n * np.dtype(t).itemsize
        yield tuple(out)
        at += 8 + size


def pack_counts(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """Pairs in order with their counts, as frames that hold the steps between pairs."""
    return b"".join(pack(np.diff(k, prepend=np.uint32(0)), c) for keys, counts in blocks for i in range(0, len(keys), FRAME) for k, c in [(keys[i : i + FRAME], counts[i : i + FRAME])])


def counts_of(blob: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for steps, counts in frames(blob, np.uint32, np.uint64):
        yield np.cumsum(steps, dtype=np.uint32), counts


def heap_merge(runs: list[Iterator[tuple[np.ndarray, np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Counts of equal pairs added up, in order; one frame of each run is held.

    The heap has the last pair of each run's frame: up to the least of them, every run's pairs are at hand.
    """
    from heapq import heapify, heapreplace, heappop

    held = [next(r, None) for r in runs]
    heap = [(int(h[0][-1]), i) for i, h in enumerate(held) if h]
    heapify(heap)
    while heap:
        bound = heap[0][0]
        got = []
        for _, i in heap:
            keys, counts = held[i]
            n = int(np.searchsorted(keys, bound, "right"))
            if n:
                got.append((keys[:n], counts[:n]))
                held[i] = keys[n:], counts[n:]
        while heap and not len(held[heap[0][1]][0]):
            i = heap[0][1]
            held[i] = next(runs[i], None)
            if held[i]:
                heapreplace(heap, (int(held[i][0][-1]), i))
            else:
                heappop(heap)
        keys, counts = (np.concatenate(x) for x in zip(*got, strict=True))
        if len(got) > 1:
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.diff(keys, prepend=keys[0] + np.uint32(1)))
            keys, counts = keys[first], np.add.reduceat(counts, first)
        yield keys, counts


def with_best(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pairs, counts, whether the count is its B id's highest), whole B ids at a time."""
    keys, counts = np.empty(0, np.uint32), np.empty(0, np.uint64)

    def judged(keys: np.ndarray, counts: np.ndarray):
        first = np.flatnonzero(np.diff(keys >> np.uint32(16), prepend=np.uint32(0xFFFFFFFF)))
        highest = np.maximum.reduceat(counts, first)
        return keys, counts, counts == np.repeat(highest, np.diff(first, append=len(keys)))

    for k, c in blocks:
        keys, counts = np.concatenate([keys, k]), np.concatenate([counts, c])
        n = int(np.searchsorted(keys, keys[-1] >> np.uint32(16) << np.uint32(16)))
        if n:
            yield judged(keys[:n], counts[:n])
            keys, counts = keys[n:], counts[n:]
    if len(keys):
        yield judged(keys, counts)


class Batch:
    """Documents of one run."""

    def __init__(self, pair: Pair):
        self.pair, self.rows, self.a, self.b, self.raw, self.tokens = pair, [], [], [], [], 0

    def add(self, rows: pa.Array, texts: list[str | None]) -> None:
        texts = [t or "" for t in texts]
        a, b = self.pair.encode(texts)
        self.rows.append(rows)
        for t, x, y in zip(texts, a, b, strict=True):
            raw = (" " + t).encode() if t else b""
            sizes = [int(s.size[ids].sum()) for s, ids in zip(self.pair.sides, (x, y), strict=True)]
            if not raw or sizes != [len(raw)] * 2:
                raw, x, y = b"", x[:0], y[:0]
            self.raw.append(raw)
            self.a.append(x)
            self.b.append(y)
            self.tokens += len(x)

    def _drop_misspelt(self) -> None:
        """Empties documents whose joined bytes differ from the text; most often there are none, so all are compared at once."""
        raw = np.frombuffer(b"".join(self.raw), np.uint8)
        ends = np.cumsum([len(r) for r in self.raw])
        for side, ids in zip(self.pair.sides, (self.a, self.b), strict=True):
            odd = np.flatnonzero(side.spelled(np.concatenate(ids)) != raw)
            for i in np.unique(np.searchsorted(ends, odd, "right")):
                self.bad.add(int(i))
        for i in self.bad:
            self.raw[i], self.a[i], self.b[i] = b"", self.a[i][:0], self.b[i][:0]

    def closed(self, groups: bool) -> tuple[dict[str, list], list[tuple[int, bytes, bytes]]]:
        """The documents' columns, and (partition, pairs, records) of the run."""
        self.bad: set[int] = set()
        self._drop_misspelt()
        a, b = np.concatenate(self.a), np.concatenate(self.b)
        n_a, n_b = (np.array([len(x) for x in xs], np.int64) for xs in (self.a, self.b))
        # texts stand one behind the other, so that ends in the same text alone can be equal
        ends = [np.cumsum(s.size[ids]) for s, ids in zip(self.pair.sides, (a, b), strict=True)]
        hit = []
        for own, other in (ends, ends[::-1]):
            mark = np.zeros(int(own[-1]) + 1 if len(own) else 1, bool)
            mark[other] = True
            hit.append(mark[own])
        doc = np.repeat(np.arange(len(n_a)), n_a)
        links = np.bincount(doc[hit[0]], minlength=len(n_a))
        digests, shown = self._groups(a, b, hit, n_a + n_b, groups)
        columns = {"n_a": n_a, "n_b": n_b, "n_groups": links, "n_links": links, "groups_sha256": digests} | ({"groups": shown} if groups else {})
        return columns, list(self._runs(a[hit[0]], b[hit[1]], doc[hit[0]]))

    def _groups(self, a: np.ndarray, b: np.ndarray, hit: list[np.ndarray], sizes: np.ndarray, groups: bool) -> tuple[list[str], list[str]]:
        at = []  # the number of the group of each token
        for h in hit:
            at.append(np.cumsum(h) - h)
        n = int(hit[0].sum())
        before_b = np.concatenate([[0], np.cumsum(np.bincount(at[1], minlength=n))])
        up_to_a = np.cumsum(np.bincount(at[0], minlength=n))
        line = np.empty(len(a) + len(b), np.uint64)
        for side, ids, h, place in ((0, a, hit[0], before_b[at[0]]), (1, b, hit[1], up_to_a[at[1]])):
            line[np.arange(len(ids)) + place] = self.pair.sides[side].shown[ids.astype(np.int64) * 2 + h]
        digests, shown, start = [], [], 0
        for end in np.cumsum(sizes).tolist():
            text = line[start:end].tobytes().translate(None, b"\0")[:-1]
            digests.append(hashlib.sha256(text).hexdigest() if text else "")
            if groups:
                shown.append(text.decode())
            start = end
        return digests, shown

    @staticmethod
    def _runs(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
        low = (b & np.uint32((1 << BITS) - 1)).astype(np.uint64)
        keys = np.sort(low << np.uint64(56) | b.astype(np.uint64) << np.uint64(40) | a.astype(np.uint64) << np.uint64(24) | doc.astype(np.uint64))
        if not len(keys):
            return
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        times = np.diff(first, append=len(keys)).astype(np.uint32)
        keys = keys[first]
        parts = keys >> np.uint64(56)
        edges = np.flatnonzero(np.diff(parts, prepend=np.uint64(255)))
        for start, end in zip(edges, [*edges[1:], len(keys)], strict=True):
            own, n = keys[start:end], times[start:end]
            pairs = (own >> np.uint64(24)).astype(np.uint32)
            at = np.flatnonzero(np.diff(pairs, prepend=~pairs[:1]))
            total = np.add.reduceat(n.astype(np.uint64), at)
            records = pack((own & np.uint64(0xFFFFFF)).astype(np.uint32), n) + pack(np.diff(at, append=len(own)).astype(np.uint32))
            yield int(parts[start]), pack_counts([(pairs[at], total)]), records


def _encoded(docs: DataFrame, files, groups: bool, run_tokens: int) -> DataFrame:
    """One row for each document (row, origin, local, counts), and one for each partition of each run (origin, bucket, docs, pairs, records)."""
    new = "origin long, local int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string," + (" groups string," if groups else "") + " bucket int, docs int, pairs binary, records binary"
    schema = StructType([StructField("row", docs.schema["row"].dataType), *StructType.fromDDL(new).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = None
        part = pyspark.TaskContext.get().partitionId()
        made, batch = 0, Batch(_pair(files))

        def rows() -> Iterator[pa.RecordBatch]:
            held = pa.concat_arrays(batch.rows)
            columns, runs = batch.closed(groups)
            n = len(held)
            both = [{"row": held, "origin": [part << 32 | made] * n, "local": np.arange(n, dtype=np.int32), **columns}]
            if runs:
                both.append({"origin": [part << 32 | made] * len(runs), "docs": [n] * len(runs)} | dict(zip(("bucket", "pairs", "records"), zip(*runs, strict=True), strict=True)))
            for values in both:
                size = len(values["origin"])
                yield pa.RecordBatch.from_arrays([v if isinstance(v := values.get(f.name), pa.Array) else pa.nulls(size, f.type) if v is None else pa.array(v, f.type) for f in arrow], schema=arrow)

        for b in batches:
            for at in range(0, b.num_rows, 64):
                some = b.slice(at, 64)
                if arrow is None:
                    arrow = pa.schema([pa.field("row", b.schema.field("row").type), *list(to_arrow_schema(schema))[1:]])
                batch.add(some.column(0), some.column(1).to_pylist())
                if batch.tokens >= run_tokens or len(batch.raw) >= RUN_DOCS:
                    yield from rows()
                    made, batch = made + 1, Batch(batch.pair)
        if batch.raw:
            yield from rows()

    return docs.mapInArrow(run, schema)


COUNTS = "bucket int, part long, pairs binary"


def _merged(got: pa.Table) -> pa.Table:
    blob = pack_counts(heap_merge([counts_of(p) for p in got.column("pairs").to_pylist()]))
    return pa.table([pa.array([got.column("bucket")[0].as_py()], pa.int32()), pa.array([got.column("part")[0].as_py()], pa.int64()), pa.array([blob], pa.binary())], names=["bucket", "part", "pairs"])


def _counted(runs: DataFrame, n_runs: int, fan_in: int) -> DataFrame:
    """(bucket, pairs): the counts of all runs' pairs; each pass merges fan_in runs or so in a task."""
    rows = runs.select("bucket", F.col("origin").alias("part"), "pairs")
    while True:
        groups = max(1, -(-n_runs // fan_in))
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(groups)))
        new = cut(dealt.groupBy("bucket", "part").applyInArrow(_merged, COUNTS))
        if hasattr(rows, "_cut_path"):
            discard(rows)
        if groups == 1:
            return new
        rows, n_runs = new, groups


def _streamed(runs: pa.Table, counts: pa.Table) -> pa.Table:
    """What the links of each run add to its documents: (origin, added: n_best and count_sum of each document)."""
    origins, out = runs.column("origin").to_pylist(), []
    held = []
    for docs, pairs, records in zip(*(runs.column(c).to_pylist() for c in ("docs", "pairs", "records")), strict=True):
        keys = np.concatenate([k for k, _ in counts_of(pairs)])
        blob = records
        split = 8 + int.from_bytes(blob[4:8], "little")
        doc, n = next(frames(blob[:split], np.uint32, np.uint32))
        (sizes,) = next(frames(blob[split:], np.uint32))
        held.append([0, keys, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), doc, n, np.zeros(docs, np.int64), np.zeros(docs, np.int64)])
    for blob in counts.column("pairs").to_pylist():
        for keys, count, best in with_best(counts_of(blob)):
            for h in held:
                at, own, edges, doc, n, best_sum, count_sum = h
                end = int(np.searchsorted(own, keys[-1], "right"))
                if end == at:
                    continue
                place = np.searchsorted(keys, own[at:end])
                some = slice(edges[at], edges[end])
                size = np.diff(edges[at : end + 1])
                d, times = doc[some], n[some].astype(np.int64)
                # exact in integers: a float would lose the last digits of large sums
                np.add.at(count_sum, d, times * np.repeat(count[place].astype(np.int64), size))
                np.add.at(best_sum, d, times * np.repeat(best[place], size))
                h[0] = end
    out = [pack(h[5], h[6]) for h in held]
    return pa.table([pa.array(origins, pa.int64()), pa.array(out, pa.binary())], names=["origin", "added"])


def _with_sums(docs: pa.Table, added: pa.Table) -> pa.Table:
    n = docs.num_rows
    sums = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
    for blob in added.column("added").to_pylist():
        for k, x in enumerate(next(frames(blob, np.int64, np.int64))):
            sums[k] += x
    local = docs.column("local").to_numpy()
    return docs.drop_columns(["origin", "local"]).append_column("n_best", pa.array(sums[0][local])).append_column("count_sum", pa.array(sums[1][local]))


class Alignment:
    """documents: the input's columns but the text, and NEW (and `groups`, if asked for); pairs(): the counts of all id pairs."""

    def __init__(self, documents: DataFrame, counts: DataFrame):
        self.documents, self._counts = documents, counts

    def pairs(self) -> DataFrame:
        """(b_id, a_id, count, best): each linked pair of ids, how many links hold it, and whether no pair with its B id has more."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob in batch.column("pairs").to_pylist():
                    for keys, counts, best in with_best(counts_of(blob)):
                        yield pa.RecordBatch.from_arrays([pa.array(keys >> np.uint32(16), pa.int32()), pa.array(keys & np.uint32(0xFFFF), pa.int32()), pa.array(counts, pa.int64()), pa.array(best)], names=["b_id", "a_id", "count", "best"])

        return self._counts.select("pairs").mapInArrow(run, "b_id int, a_id int, count long, best boolean")


def align(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", groups: bool = False, run_tokens: int = RUN_TOKENS, fan_in: int = FAN_IN) -> Alignment:
    """Link the tokens of byte-level BPE (a `tokenizers` file, over a space and the text) and of a piece model (which adds the space).

    Strings of special tokens in a text are plain text. Tokens that end at the same byte are linked, and such bytes cut both
    sequences into groups, shown as `a,a|b;a|b,b`. Null and empty texts, and those that either side's tokens don't spell out
    again, have no tokens: zeros and an empty groups_sha256. Repeated rows count as often as they stand there; an empty table
    gives an empty one. Input columns named like the new ones are replaced, the text is left out. Both vocabulary files are read
    by the driver and sent to the executors; ids of A are below 65,536, of B too.
    """
    new = {f.name for f in StructType.fromDDL(NEW).fields} | {"groups"}
    kept = [c for c in docs.columns if c != text_col and c not in new]
    with open(b_path, "rb") as f:
        model = f.read()
    files = docs.sparkSession.sparkContext.broadcast((load_spec(a_path), model, hashlib.sha256(f"{a_path}\n{b_path}".encode()).hexdigest()))
    row = F.struct(*kept) if kept else F.struct(F.lit(None).cast("int").alias("nothing"))
    table = cut(_encoded(docs.select(row.alias("row"), F.col(text_col).cast("string").alias("text")), files, groups, run_tokens))
    runs = table.where("bucket IS NOT NULL").select("origin", "bucket", "docs", "pairs", "records")
    n_runs = runs.select("origin").distinct().count()
    counts = _counted(runs, n_runs, fan_in)
    copies = max(1, -(-n_runs // fan_in))
    dealt = runs.withColumn("copy", F.pmod(F.xxhash64("origin"), F.lit(copies)))
    spread = counts.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias("copy"), "pairs")
    added = dealt.groupBy("bucket", "copy").cogroup(spread.groupBy("bucket", "copy")).applyInArrow(_streamed, "origin long, added binary")
    shown = table.where("row IS NOT NULL").drop("bucket", "docs", "pairs", "records")
    schema = StructType([f for f in shown.schema.fields if f.name not in ("origin", "local")] + StructType.fromDDL("n_best long, count_sum long").fields)
    out = shown.groupBy("origin").cogroup(added.groupBy("origin")).applyInArrow(_with_sums, schema)
    names = [f.name for f in StructType.fromDDL(NEW).fields] + (["groups"] if groups else [])
    return Alignment(out.select(*([F.col(f"row.`{c}`").alias(c) for c in kept]), *names), counts)


@cache
def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align(docs, *default_paths()).documents
