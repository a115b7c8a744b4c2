"""Numbering, running totals, top lists and packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.plans.session import shared_table


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def first_n(df: DataFrame, part: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group along an order; ties in the order are broken at will."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


#: Rows of a range of running_total.
ROWS_A_RANGE = 200_000


def running_total(df: DataFrame, order: str, size: Column, name: str, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """Adds the sum of `size` up to and with each row along a unique order column, without a window over the whole table.

    The input is computed once and written. It is dealt out by ranges of the order column, as many as its rows ask for, and where
    they are several, written with them: ranges are cut by a sample, and a second reading would cut them elsewhere. Each range has
    its own window, and what stands before a range is one row for each range, sent to all tasks. Nulls come first.
    """
    once = shared_table(df.withColumn("_size", size))
    ranges = max(1, -(-once.count() // rows_a_range))
    ranged = once.withColumn("_range", F.lit(0)) if ranges == 1 else shared_table(once.repartitionByRange(ranges, order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(F.sum("_size").alias("_sum"))
    before = totals.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.sum("_size").over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_inner", inner).join(F.broadcast(before), "_range").withColumn(name, F.col("_inner") + F.col("_before")).drop("_size", "_range", "_before", "_inner")


def number_rows(df: DataFrame, order: str, prefix: str, width: int = 3) -> DataFrame:
    """Adds code: the prefix and the row's place along a unique order column."""
    n = running_total(df, order, F.lit(1).cast("long"), "_no")
    digits = F.col("_no").cast("string")
    return n.withColumn("code", F.concat(F.lit(prefix), F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0")))).drop("_no")


def page_ranges(docs: DataFrame, order: str, pages: Column) -> DataFrame:
    """Adds page_from and page_to over the whole corpus; a document without text still takes one page."""
    out = running_total(docs.withColumn("_pages", F.greatest(pages, F.lit(1).cast("long"))), order, F.col("_pages"), "page_to")
    return out.withColumn("page_from", F.col("page_to") - F.col("_pages") + 1).drop("_pages")


def pack_parts(docs: DataFrame, order: str, size: Column, limit: int) -> DataFrame:
    """Adds part: whole limits filled before the row. A part may exceed the limit by its last document."""
    out = running_total(docs.withColumn("_own", size), order, F.col("_own"), "_total")
    return out.withColumn("part", F.floor((F.col("_total") - F.col("_own")) / limit)).drop("_own", "_total")


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def distribution(docs: DataFrame, by: list[str]) -> DataFrame:
    """(dimension, value, docs) for each of several columns, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in by])).alias("p")
    return docs.select(pairs).groupBy("p.dimension", "p.value").agg(F.count("*").alias("docs"))
