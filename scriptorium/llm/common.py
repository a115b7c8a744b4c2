"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: bytes.split() and str.split(None) differ from WORD on non-ASCII blanks, so texts are split with this table first.
_BLANKS = "\t\n\x0b\x0c\r"
_TO_SPACE = str.maketrans(dict.fromkeys(_BLANKS, " "))
#: A-Z only: other letters keep their case.
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_LOWER)


def words_of(text: str) -> list[str]:
    """The words of a text; null and blank texts have none."""
    if not text:
        return []
    for blank in _BLANKS:
        if blank in text:
            text = text.replace(blank, " ")
    return [w for w in text.split(" ") if w]


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and cut tables; one of our own only in a local session that names none."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = getattr(sc, "_scriptorium_dir", None) or tempfile.mkdtemp(prefix="spark-")
        sc._scriptorium_dir = folder
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, *by: str) -> DataFrame:
    """Write once to the shared folder, in a folder for each value of the columns `by`, and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/cut-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table made by cut() once nothing reads it any more."""
    spark, path = df.sparkSession, df._cut_path
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def in_python(docs: DataFrame, columns: list[str], new: str, work: Callable[..., tuple], rows: int = 256) -> DataFrame:
    """docs with new columns (a DDL string) that work(values of each of `columns`) gives as a tuple of lists, some rows at a time.

    Other columns go through as Arrow data, so their nulls, large integers and nested values stay what they are. Columns named
    like the new ones are replaced, unless work reads them.
    """
    added = StructType.fromDDL(new)
    names = [f.name for f in added.fields]
    kept = docs.drop(*[n for n in names if n not in columns])
    types = [to_arrow_type(f.dataType) for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                got = work(*[part.column(c).to_pylist() for c in columns])
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(v, t) for v, t in zip(got, types, strict=True))], names=[*part.schema.names, *names])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, *added.fields]))


def remainder(col: str = "doc_id", by: int = 5):
    """crc32 of the id as text, modulo `by`; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % by


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    edges: undirected pairs of longs, any order, repeats and loops allowed. Returns (node, root): every node that has an
    edge to another node, with the smallest node it can reach, itself included. Each round is written to the shared folder.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    cur = cut(e)
    seen = None
    for _ in range(max_rounds):
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large-star: every larger neighbour of u is tied to the least of u and its neighbours
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: u and its smaller neighbours are tied to the least of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct()
        )
        new = cut(small)
        stamp = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(cur)
        cur = new
        if stamp == seen:
            break
        seen = stamp
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    stars = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select("root", "root").distinct())
