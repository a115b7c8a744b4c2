"""WARC archives written from a table and read back (operator 12).

Records are verified by their chain. Files are read in splits; every place that looks like the start of a record is a candidate,
with its successor's offset by its own length. Each task follows the chains of its split to where they leave it; pointer jumping
over these from the start of each file, in as many rounds as the number of splits has binary digits, keeps what can be reached.
A record's start inside the payload of another is a candidate too, but nothing leads to it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard, scratch_dir, table

#: What every record starts with, before 0 or 1 and a line end, and the letters of base 32.
MAGIC = b"WARC/1."
BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
#: Splits whose starts are sent to all tasks; more of them are joined by shuffle.
SENT_SPLITS = 100_000
#: A payload that more than one row in so many has is looked up in a list sent to all tasks (at most so many entries).
HOT_SHARE = 1_000
RECORD = "file string, offset long, record_type string, record_id string, refers_to string, target_uri string, payload_digest string, header string, payload binary"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base 32: 8 groups of 20 bits, 4 letters each."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lpad(F.conv(F.substring(F.sha1(data), i * 5 + 1, F.lit(5)), 16, 32), 4, "0"))
    return F.translate(F.array_join(groups, ""), *BASE32)


# --- writing ---


def with_revisits(pages: DataFrame, id_col: str, payload_col: str, least_bytes: int = 0) -> DataFrame:
    """Adds payload_digest, record_type and refers_to.

    Of rows with equal payloads of at least least_bytes, the one with the largest id is the response (all of those that tie for
    it, and all where every id is null), the others are revisits of it; other rows are responses. A null payload counts as empty.
    Columns named like the new ones are replaced.
    """
    pages = pages.drop("payload_digest", "record_type", "refers_to", "_hot", "_key")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    keyed = pages.withColumn("payload_digest", base32_sha1(payload))
    rows = keyed.select("payload_digest", F.col(id_col).alias("_id"), (F.length(payload) >= least_bytes).alias("_long")).where("_long")
    groups = cut(rows.groupBy("payload_digest").agg(F.max("_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1"))
    total = pages.count()
    # no more than HOT_SHARE groups can have more than 1 / HOT_SHARE of the rows, so the first list is short
    hot = F.col("_n") * HOT_SHARE > total
    short = groups.where(hot).select(F.col("payload_digest").alias("_hot"), F.col("_last").alias("_hot_last"))
    rest = groups.where(~hot).select(F.col("payload_digest").alias("_key"), F.col("_last").alias("_key_last"))
    marked = keyed.join(F.broadcast(short), F.col("payload_digest") == F.col("_hot"), "left")
    # rows of hot groups find nothing in the other list, so their key only has to spread them
    key = F.when(F.col("_hot").isNotNull(), F.concat(F.lit("-"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).otherwise(F.col("payload_digest"))
    marked = marked.withColumn("_at", key).join(rest.hint("shuffle_hash"), F.col("_at") == F.col("_key"), "left")
    last, own = F.coalesce("_hot_last", "_key_last"), F.col(id_col)
    revisit = last.isNotNull() & ~own.eqNullSafe(last)
    return marked.select(*keyed.columns, F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, last).alias("refers_to"))


def _one_line(value: Column) -> Column:
    """A header value without line ends, which are written as in URLs."""
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def record_uri(row_id: Column, digest: Column) -> Column:
    """A record's id: the row's id and its payload's digest."""
    return F.concat(F.lit("<urn:x-row:"), F.coalesce(row_id.cast("string"), F.lit("")), F.lit(":"), digest, F.lit(">"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z", least_bytes: int = 0) -> None:
    """Write a response or revisit record for each row to the files of a new folder.

    The block is an HTTP message with the payload as its body; revisits (see with_revisits) have the header alone. Rows may
    repeat and be null in any column (no target, an empty payload); other columns are left out. An empty table makes a folder
    without records.
    """
    rows = with_revisits(pages.select(id_col, url_col, payload_col), id_col, payload_col, least_bytes)
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    size = F.octet_length(body).cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    revisit = F.col("record_type") == "revisit"
    block = F.concat(http, F.when(revisit, "").otherwise(body))
    digest = F.col("payload_digest")
    target = F.concat(F.lit("\r\nWARC-Target-URI: "), _one_line(F.col(url_col)))
    refers = F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), record_uri(F.col("refers_to"), digest))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: "), record_uri(F.col(id_col), digest), F.lit(f"\r\nWARC-Date: {date}"),
        F.coalesce(target, F.lit("")), F.when(revisit, refers).otherwise(""), F.lit("\r\nWARC-Payload-Digest: sha1:"), digest,
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


# --- reading ---

_HEAD = re.compile(rb"[01]\r\n((?:[!-9;-~]+:[^\r\n]*\r\n)+)\r\n")
_LENGTH = re.compile(rb"(?:^|\n)content-length:[ \t]*([0-9]{1,18})[ \t]*\r", re.I)


def parse_start(chunk: bytes) -> tuple[int, int] | None:
    """(bytes of the header, bytes of the block) where what follows MAGIC is a record's header, else None."""
    head = _HEAD.match(chunk)
    size = head and _LENGTH.search(head[1])
    return (len(MAGIC) + head.end(), int(size[1])) if size else None


def read_record(head: bytes, block: bytes) -> tuple:
    """The columns of RECORD after the offset. The payload of an HTTP message is its body as it stands; of other blocks, all of it."""
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            fields.setdefault(name.lower(), value.strip().decode("utf-8", "replace"))
    get = lambda name: fields.get(name)
    if (get(b"content-type") or "").lower().startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    return get(b"warc-type"), get(b"warc-record-id"), get(b"warc-refers-to"), get(b"warc-target-uri"), get(b"warc-payload-digest"), head.decode("utf-8", "replace"), block


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, chunk): what stands before, between and after the MAGICs of each file, in order in each split; a split has the chunks whose MAGIC starts in it."""
    lines = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("chunk"))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple[int, int, bytes, dict]]]]:
    """Rows in order as (key, place in the split, whether MAGIC stands before the chunk, chunk, row)."""
    key, at = None, 0
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            for row in batch.slice(k, 64).to_pylist():
                own = row["file"], row["split"]
                if own != key:
                    key, at = own, 0
                    first = row["split"] == 0  # a file's first chunk has no MAGIC before it
                else:
                    first = False
                yield key, at, not first, row["chunk"], row
                at += len(row["chunk"]) + (0 if first else len(MAGIC))


LINKS = "file string, split long, bytes long, links array<struct<at:long,to:long,last:long>>"
_LINKS = pa.schema([("file", pa.string()), ("split", pa.int64()), ("bytes", pa.int64()), ("links", pa.list_(pa.struct([(c, pa.int64()) for c in ("at", "to", "last")])))])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split its size, and for each candidate where its chain leaves the split (null if it ends inside) and the last candidate on that way, all from the split's first byte."""
    def closed(key, size: int, found: dict[int, int]) -> pa.RecordBatch:
        ways: dict[int, tuple[int | None, int]] = {}
        for at in sorted(found, reverse=True):
            to = found[at]
            ways[at] = (to, at) if to >= size else ways.get(to, (None, at))
        return pa.RecordBatch.from_pylist([{"file": key[0], "split": key[1], "bytes": size, "links": [{"at": a, "to": t, "last": e} for a, (t, e) in sorted(ways.items())]}], _LINKS)

    key, size, found = None, 0, {}
    for own, at, marked, chunk, _ in _by_split(batches):
        if own != key:
            if key is not None:
                yield closed(key, size, found)
            key, found = own, {}
        start = parse_start(chunk) if marked else None
        if start:
            found[at] = at + sum(start) + 4
        size = at + len(chunk) + (len(MAGIC) if marked else 0)
    if key is not None:
        yield closed(key, size, found)


def _entries(links: DataFrame) -> DataFrame:
    """(file, split, base, bytes, total, entry, owner) of each split: its first byte's offset, the file's size, the first reachable record in it (offset, or null) and the last one before it."""
    order = Window.partitionBy("file").orderBy("split")
    splits = cut(links.withColumn("base", F.sum("bytes").over(order) - F.col("bytes")).withColumn("total", F.sum("bytes").over(Window.partitionBy("file"))))
    each = splits.select("file", "split", "base", "total", F.explode("links").alias("l"))
    shift = lambda c: (F.col("base") + F.col(f"l.{c}")).alias(c)
    nodes = cut(each.select("file", "split", "total", shift("at"), shift("to"), shift("last")))
    starts = splits.select("file").distinct().select("file", F.lit(0).cast("long").alias("at"))
    # only what another split's chain leads to can be an entry
    aims = nodes.where("to < total").select("file", F.col("to").alias("at")).union(starts).distinct()
    jumps = cut(nodes.join(aims, ["file", "at"], "left_semi").where("to < total").select("file", "at", "to"))
    reached, known = cut(starts), -1
    while True:
        step = reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        new = cut(reached.union(step).distinct())
        discard(reached)
        reached, n = new, new.count()
        if n == known:
            break
        known = n
        twice = jumps.join(jumps.select("file", F.col("at").alias("to"), F.col("to").alias("then")), ["file", "to"], "left")
        far = cut(twice.select("file", "at", F.coalesce("then", "to").alias("to")))
        discard(jumps)
        jumps = far
    entry = nodes.join(reached, ["file", "at"], "left_semi").select("file", "split", F.col("at").alias("entry"), "last", "to")
    out = splits.select("file", "split", "base", "bytes", "total").join(entry, ["file", "split"], "left")
    before = F.last(F.when(F.col("entry").isNotNull(), F.struct("last", "to")), True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("_b", before).withColumn("owner", F.when((F.col("_b.to") > F.col("base")) & (F.col("_b.to") <= F.col("total")), F.col("_b.last")))
    out = cut(out.withColumn("until", F.col("_b.to")).drop("_b"))
    for df in (splits, nodes, jumps, reached):
        discard(df)
    return out


PIECE = f"{RECORD}, place long, piece binary"
_RECORD = pa.schema([(c.split()[0], {"long": pa.int64(), "binary": pa.binary()}.get(c.split()[1], pa.string())) for c in RECORD.split(", ")])
_PIECE = pa.schema([*_RECORD, ("place", pa.int64()), ("piece", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _records(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """With `whole`, the records that end in the split where they start; else the parts of the others."""
    out, held = [], 0
    nothing = (None,) * 7
    key = offset = None
    parts: list[bytes] = []
    first = need = want = 0

    def part() -> list[tuple]:
        return [] if whole or offset is None or not parts else [(key[0], offset, *nothing, first, b"".join(parts))]

    for own, at, marked, chunk, row in _by_split(batches):
        if own != key:
            out += part()
            key, parts, want = own, [], row["entry"]
            offset, first = row["owner"], row["base"]
            need = row["until"] - row["base"] if offset is not None else 0
        place = row["base"] + at
        data = (MAGIC if marked else b"") + chunk
        if marked and place == want:
            out += part()
            start = parse_start(chunk)
            want = place + sum(start) + 4 if start else -1
            if not start or want > row["total"]:
                offset, parts, need, want = None, [], 0, -1
            else:
                offset, first, parts, need = place, place, [], sum(start) + 4
        if offset is not None and need > 0:
            parts.append(data[:need])
            need -= len(parts[-1])
            if need == 0 and first == offset:
                if whole:
                    data = b"".join(parts)
                    head, block = parse_start(data[len(MAGIC) :])
                    out.append((key[0], offset, *read_record(data[: head - 4], data[head : head + block]), offset, None))
                    held += len(data)
                parts = []
                offset = None
        if held > 1 << 23 or len(out) >= 1024:
            yield _batch(out, _PIECE)
            out, held = [], 0
    out += part()
    if out:
        yield _batch(out, _PIECE)


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            data = b"".join(p["piece"] for p in row["pieces"])
            head, block = parse_start(data[len(MAGIC) :])
            yield _batch([(row["file"], row["offset"], *read_record(data[: head - 4], data[head : head + block]))], _RECORD)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC 1.0 and 1.1 files (plain, or .gz, which are not split) that the chain from each file's start reaches.

    Returns (file, offset, record_type, record_id, refers_to, target_uri, payload_digest, header, payload); null where a header
    lacks the field. A chain ends where no record starts at the next offset, or where a record runs past the file's end: that
    record, and all behind the end of a chain, are left out. Files without records give no rows. The result reads the files
    when it is used.
    """
    chunks = _chunks(spark, path)
    splits = _entries(chunks.mapInArrow(_links, LINKS))
    few = splits.count() <= SENT_SPLITS

    def scanned(some: DataFrame, whole: bool) -> DataFrame:
        if few:
            rows = chunks.join(F.broadcast(some), ["file", "split"])
        else:
            rows = chunks.withColumn("_row", F.monotonically_increasing_id()).join(some, ["file", "split"]).sortWithinPartitions("file", "split", "_row").drop("_row")
        return rows.mapInArrow(lambda b: _records(b, whole), PIECE)

    out = scanned(splits, True).select(*_RECORD.names)
    # a record that a MAGIC of its payload carries over the end of its split is put together from its parts
    ends = F.col("base") + F.col("bytes")
    torn = splits.where(F.col("to").between(ends + 1, F.col("total")) | F.col("owner").isNotNull())
    if torn.limit(1).count():
        parts = scanned(torn, False).groupBy("file", "offset").agg(F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("pieces"))
        out = out.union(parts.mapInArrow(_assembled, RECORD))
    return out


def resolved(records: DataFrame) -> DataFrame:
    """(row_id, payload_bytes, payload_digest, record_type, refers_to) of records of write_warc, counted from the payloads themselves; those of revisits from the record that they refer to.

    A revisit whose response is missing, or has another digest than it states, has null for both.
    """
    row = lambda c: F.nullif(F.regexp_extract(c, "^<urn:x-row:(.*):[A-Z2-7]+>$", 1), F.lit(""))
    own = cut(
        records.select("record_type", "record_id", "refers_to", F.length("payload").cast("long").alias("n"), base32_sha1(F.col("payload")).alias("digest"), F.regexp_replace("payload_digest", "^sha1:", "").alias("stated"))
    )
    answers = own.where("record_type = 'response' AND digest = stated").select(F.col("record_id").alias("_of"), F.col("n").alias("_n"), F.col("digest").alias("_digest")).distinct()
    visits = own.where("record_type = 'revisit'")
    counts = cut(visits.groupBy("refers_to").count())
    total = own.count()
    hot = cut(counts.where(F.col("count") * HOT_SHARE > total).select(F.col("refers_to").alias("_of")))
    short = answers.join(F.broadcast(hot), "_of", "left_semi")
    rest = answers.join(counts.select(F.col("refers_to").alias("_of")), "_of", "left_semi")
    is_hot = visits.join(F.broadcast(hot.select(F.col("_of").alias("refers_to"), F.lit(True).alias("_hot"))), "refers_to", "left").fillna(False, ["_hot"])
    found = [
        is_hot.where("_hot").join(F.broadcast(short), F.col("refers_to") == F.col("_of"), "left"),
        is_hot.where("NOT _hot").join(rest, F.col("refers_to") == F.col("_of"), "left"),
    ]
    same = F.col("_digest") == F.col("stated")
    shown = [f.select(row("record_id").alias("row_id"), F.when(same, F.col("_n")).alias("payload_bytes"), F.when(same, F.col("_digest")).alias("payload_digest"), "record_type", row("refers_to").alias("refers_to")) for f in found]
    plain = own.where("record_type <> 'revisit'").select(row("record_id").alias("row_id"), F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("string").alias("refers_to"))
    return plain.union(shown[0]).union(shown[1])


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    got = resolved(read_warc(spark, path))  # what it needs of the archives is read by now
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return got.select(F.col("row_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS last FROM p)
SELECT page_id, payload_bytes, translate(array_to_string(list_transform(range(0, 8), lambda i: to_base(('0x' || substr(hex, i::BIGINT * 5 + 1, 5))::BIGINT, 32, 4)), ''), '{BASE32[0]}', '{BASE32[1]}') AS payload_digest,
    CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
"""
