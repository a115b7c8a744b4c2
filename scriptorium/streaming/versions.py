"""Versions of a table in a folder: each has its own data, and one small file that says so makes it visible.

path/data/<name> holds a version's rows; path/versions/<number>.json names it, its parent and the run that made it. That file is
written under another name and renamed, so readers see a version whole or not at all, and older ones stay as backups.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.streaming.incremental import keep_best

MANIFEST = "version long, folder string, parent long, run string"


class VersionConflict(RuntimeError):
    """Another writer has made a version meanwhile."""


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def versions(spark: SparkSession, path: str) -> DataFrame:
    """(version, folder, parent, run), one row for each version; none where the folder does not exist yet."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/versions")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def write_version(rows: DataFrame, path: str, run: str | None = None, parent: int | None = None) -> int:
    """Write rows as the version after `parent` (the latest, if None) and return its number.

    A run that has made a version before makes no other: its number is returned and nothing is written, so a job that is run
    again after a crash is safe. Data of a writer that dies before its version is named is never read. If another writer has made
    that version meanwhile, VersionConflict is raised: read the latest and apply the change to it.
    """
    spark = rows.sparkSession
    known = versions(spark, path)
    if run is not None and (done := known.where(F.col("run") == run).select("version").first()):
        return done.version
    last = known.agg(F.max("version").alias("v")).first().v
    parent = last if parent is None else parent
    number = 1 if parent is None else parent + 1
    folder = f"data/{number:09d}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{folder}")
    fs, target = _files(spark, f"{path}/versions/{number:09d}.json")
    _, hidden = _files(spark, f"{path}/versions/.{number:09d}-{uuid.uuid4().hex}")
    out = fs.create(hidden, False)
    out.write(bytearray(json.dumps({"version": number, "folder": folder, "parent": parent, "run": run}).encode()))
    out.close()
    # a rename onto a name that exists fails in shared file systems; the local one would replace it, so look first
    if fs.exists(target) or not fs.rename(hidden, target):
        fs.delete(hidden, False)
        fs.delete(_files(spark, f"{path}/{folder}")[1], True)
        raise VersionConflict(f"version {number} of {path} is there already")
    return number


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, by default of the latest. ValueError where there is none."""
    known = versions(spark, path)
    row = (known.orderBy(F.desc("version")) if version is None else known.where(F.col("version") == version)).first()
    if row is None:
        raise ValueError(f"no version {'' if version is None else version} in {path}")
    return spark.read.parquet(f"{path}/{row.folder}")


def with_best_texts(docs: DataFrame, candidates: DataFrame, delta: float = 8.0, enough: float = 60.0) -> DataFrame:
    """docs(doc_id, text, quality, replaced, old_text, ...) with the texts of better candidates(doc_id, text, quality), and `decision`.

    See keep_best for the decisions. Where it is `replaced`, text and quality are the candidate's, and old_text keeps the first
    text for good. Of a document's candidates the best counts, of equally good ones the text that sorts first; a candidate without
    text replaces nothing. Ids are unique in docs.
    """
    usable = candidates.where("text IS NOT NULL AND quality IS NOT NULL")
    best = usable.groupBy("doc_id").agg(F.min(F.struct((-F.col("quality")).alias("_q"), F.col("text").alias("_text"))).alias("_best")).select("doc_id", "_best._text")
    judged = keep_best(docs, usable, delta, enough).join(best, "doc_id", "left")
    new = F.col("decision") == "replaced"
    values = {
        "old_text": F.when(new, F.coalesce("old_text", "text")).otherwise(F.col("old_text")),
        "text": F.when(new, F.col("_text")).otherwise(F.col("text")),
        "quality": F.when(new, F.col("new_quality")).otherwise(F.col("quality")),
        "replaced": F.coalesce("replaced", F.lit(False)) | new,
    }
    return judged.select(*[values[c].alias(c) if c in values else F.col(c) for c in docs.columns if c != "decision"], "decision")


def update_version(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], run: str, tries: int = 5) -> int:
    """Apply change(rows) to the latest version as a new one; where another writer is quicker, apply it to theirs."""
    for _ in range(tries):
        last = versions(spark, path).agg(F.max("version").alias("v")).first().v
        try:
            return write_version(change(read_version(spark, path, last)), path, run, last)
        except VersionConflict:
            continue
    raise VersionConflict(f"{path} changed {tries} times meanwhile")
