"""Append-only batches and keep-the-better updates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import strip
from scriptorium.operators import extract, lines, reports


def keep_best(docs: DataFrame, candidates: DataFrame, delta: float = 8.0, enough: float = 60.0) -> DataFrame:
    """docs(doc_id, quality, replaced) against candidates(doc_id, quality): adds decision.

    missing: no candidate; skipped: replaced before or good enough already; replaced: better by more than delta; else kept.
    The best candidate of a document counts.
    """
    best = candidates.groupBy("doc_id").agg(F.max("quality").alias("new_quality"))
    decision = (
        F.when(F.col("replaced") | (F.col("quality") >= enough), "skipped")
        .when(F.col("new_quality").isNull(), "missing")
        .when(F.col("new_quality") - F.col("quality") > delta, "replaced")
        .otherwise("kept")
    )
    return docs.join(best, "doc_id", "left").withColumn("decision", decision)


def outcome_counts(updates: DataFrame) -> DataFrame:
    return updates.groupBy("decision").agg(F.count("*").alias("docs"))


def best_variant(candidates: DataFrame) -> DataFrame:
    """Of candidates(doc_id, page_no, variant, variant_ord, quality) the best of each page; ties go to the first variant."""
    w = Window.partitionBy("doc_id", "page_no").orderBy(F.desc("quality"), "variant_ord")
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def apply_update(docs: DataFrame, changes: DataFrame, path: str, version: int) -> str:
    """Write docs with changed texts as a new version directory; older versions stay as backups."""
    new = docs.join(changes.select("doc_id", F.col("text").alias("_new")), "doc_id", "left").withColumn("text", F.coalesce("_new", "text")).drop("_new")
    target = f"{path}/v={version}"
    new.write.mode("errorifexists").parquet(target)
    return target


def ingest_stream(spark: SparkSession, source: str, schema, target: str, checkpoint: str, key: str = "id", fmt: str = "parquet", prepare: Callable[[DataFrame], DataFrame] | None = None):
    """Append rows of new files whose key the target does not hold yet; within a batch the first row of a key counts.

    A null key is a key like any other. `prepare` turns the new rows of a batch into the rows to be written and keeps the key.
    A file-source stream that takes what is there and ends; its checkpoint makes reruns add nothing. Returns the ended query.
    """

    def add(batch: DataFrame, _: int) -> None:
        keys = batch.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("n"))
        new, held = keys, True
        try:
            known = spark.read.parquet(target).select(F.col(key).alias("_known"))
            new = keys.join(known, F.col("_key").eqNullSafe(F.col("_known")), "left_anti")
        except AnalysisException as e:  # the first batch finds no target
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            held = False
        # keys alone are shuffled to see what is new: whole rows only where some of a batch are known or repeated
        total = keys.agg(F.count("*").alias("keys"), F.max("n").alias("most")).first()
        unseen = new.count() if held else total["keys"]
        if held and not unseen:
            return
        fresh = batch.dropDuplicates([key]) if (total.most or 0) > 1 else batch
        if unseen < total["keys"]:
            fresh = fresh.join(new, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
        fresh = fresh.select(*batch.columns)
        (prepare(fresh) if prepare else fresh).write.mode("append").parquet(target)

    query = spark.readStream.schema(schema).format(fmt).load(source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def dedupe_stream(spark: SparkSession, source: str, schema, target: str, checkpoint: str, key: str, time: str, delay: str, fmt: str = "parquet", files_a_batch: int | None = None):
    """Append the first row of each key from new files, with state for `delay` behind the latest time alone.

    A row whose key came before is dropped while the key's time plus delay is ahead of the watermark (the latest time so far less
    delay); rows behind the watermark are late and dropped whatever their key. Keys further apart than delay can come again: the
    state is bounded by the rows of that span, not by all keys. Rows without a time are left out; a null key is a key like any
    other. Takes what is there and ends; with the same checkpoint a rerun adds nothing. Returns the ended query.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    reader = reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader
    rows = reader.load(source).withColumn(time, F.col(time).cast("timestamp")).where(F.col(time).isNotNull())
    once = rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    query = once.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _beside(docs: DataFrame, f: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """docs with a column of f(docs), where f reads each row alone: the whole row goes in place of its id, so that nothing is joined."""
    return f(docs.withColumn("doc_id", F.struct(*docs.columns))).select("doc_id.*", name)


def prepare_documents(docs: DataFrame, rules: DataFrame, authorities: Sequence[str], patterns: dict[str, str], script: str | None = None) -> DataFrame:
    """New docs(doc_id, title, text) as records: type, card, long numbers, dates, quality and whether there is text to read. Ids are unique.

    All of it is found in the row that holds the text; only a list of rules that is too long for that is joined, by id.
    """
    rows = docs.select("doc_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    short = extract.rule_rows(rules.select("label", "pattern", "ord").where("pattern is not null")) is not None
    typed = lambda d: extract.classify_type(d, rules)
    rows = _beside(rows, typed, "doc_type") if short else rows.join(typed(rows), "doc_id")
    rows = _beside(rows, lambda d: reports.build_cards(d, authorities, patterns), "card")
    rows = _beside(rows, lambda d: lines.quality_metrics(d, *([script] if script else [])), "quality")
    text = F.col("text")
    return rows.select(
        "doc_id", "title", extract.long_numbers(text).alias("numbers"), extract.dates(text, extract.HIJRI).alias("hijri_dates"), extract.dates(text, extract.GREGORIAN).alias("gregorian_dates"),
        (strip(text) != "").alias("readable"), "text", "doc_type", "card", "quality",
    )


def ingest_documents(spark: SparkSession, source: str, schema, target: str, checkpoint: str, rules: DataFrame, authorities: Sequence[str], patterns: dict[str, str], script: str | None = None, rename: Callable[[DataFrame], DataFrame] | None = None):
    """Append new documents with what prepare_documents finds in them; `rename` brings source columns to (doc_id, title, text)."""
    return ingest_stream(spark, source, schema, target, checkpoint, "doc_id", prepare=lambda b: prepare_documents(rename(b) if rename else b, rules, authorities, patterns, script))
