"""Search over postings: boolean, by prefixes, and ranked by BM25."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import light_stem, search_form, tokens
from scriptorium.plans.session import shared_table


def _words(docs: DataFrame, words: Column) -> DataFrame:
    """(doc_id, words), a row for each id: the words of rows with one id are put together, so that the rest is done inside the row."""
    rows = docs.select("doc_id", words.alias("words"))
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        rows = rows.groupBy("doc_id").agg(F.flatten(F.collect_list("words")).alias("words"))
    return rows.where(F.size("words") > 0)


def postings(docs: DataFrame, stem: bool = False, least: int = 2) -> DataFrame:
    """(term, doc_id, tf)"""
    t = docs.select("doc_id", F.explode(tokens(F.col("text"), least)).alias("term"))
    return (t.withColumn("term", light_stem(F.col("term"))) if stem else t).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def bm25(index: DataFrame, query: list[str], k1: float = 1.5, b: float = 0.75, sizes: DataFrame | None = None) -> DataFrame:
    """(doc_id, score) of documents with any query term, from postings; sizes(doc_id, length) are added up from them if not given."""
    sizes = index.groupBy("doc_id").agg(F.sum("tf").alias("length")) if sizes is None else sizes.where("length > 0")
    total = sizes.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    hits = index.where(F.col("term").isin(list(dict.fromkeys(query))))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # one row for each query term
    rows = hits.join(F.broadcast(df), "term").join(sizes, "doc_id").join(F.broadcast(total))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return rows.groupBy("doc_id").agg(F.sum(part).alias("score"))


def build_search_table(docs: DataFrame, path: str, stem: bool = True) -> None:
    """Write docs with the number of their terms to path/docs and postings in the order of terms to path/postings, so that a query reads few row groups."""
    docs.withColumn("length", F.size(F.coalesce(tokens(F.col("text")), F.array().cast("array<string>"))).cast("long")).write.mode("overwrite").parquet(f"{path}/docs")
    postings(docs, stem).repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")


def search_table(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(docs, postings) as written by build_search_table."""
    return spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/postings")


#: Buckets of terms: a query reads those of its terms alone.
TERM_BUCKETS = 64


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def extend_index(docs: DataFrame, path: str, batch: int, stem: bool = True) -> None:
    """Add new docs(doc_id, text) to a search index in a folder.

    postings/batch=/bucket=: (term, doc_id, tf, length) in the order of terms, with the document's length, so that a query needs
    no table of documents; terms/batch=/bucket=: (term, df) of the batch; totals/batch=: documents with terms and their terms.
    Nothing that stands there is read but the ids of other batches: documents that these hold are left out. Writing a batch again
    replaces it. Of repeated ids in a batch the texts count as one document; null texts have no terms.
    """
    spark = docs.sparkSession
    fresh = docs.select("doc_id", "text")
    try:
        known = spark.read.parquet(f"{path}/ids").where(F.col("batch") != batch).select(F.col("doc_id").alias("_id")).distinct()
        fresh = fresh.join(known, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    tf = shared_table(postings(fresh, stem))
    sizes = tf.groupBy("doc_id").agg(F.sum("tf").alias("length"))
    rows = tf.join(sizes, "doc_id")
    own = {"batch": F.lit(batch), "bucket": _bucket(F.col("term"))}

    def put(df: DataFrame, name: str, *by: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{path}/{name}")

    put(rows.withColumns(own).repartition("bucket").sortWithinPartitions("bucket", "term", "doc_id"), "postings", "batch", "bucket")
    put(tf.groupBy("term").agg(F.count("*").alias("df")).withColumns(own).repartition("bucket").sortWithinPartitions("bucket", "term"), "terms", "batch", "bucket")
    put(sizes.agg(F.count("*").alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).withColumn("batch", F.lit(batch)), "totals", "batch")
    put(fresh.select("doc_id").distinct().withColumn("batch", F.lit(batch)), "ids", "batch")


def term_stats(spark: SparkSession, path: str, terms: list[str] | None = None) -> DataFrame:
    """(term, df) over all batches of an index, of some terms or all."""
    stats = spark.read.parquet(f"{path}/terms")
    if terms is not None:
        stats = _of_terms(stats, terms)
    return stats.groupBy("term").agg(F.sum("df").alias("df"))


def _of_terms(table: DataFrame, terms: list[str]) -> DataFrame:
    """The rows of some terms; their buckets are constants, so other folders are not listed for reading."""
    spark = table.sparkSession
    buckets = [r.b for r in spark.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t")).alias("b")).distinct().collect()]
    return table.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))


def search_index(spark: SparkSession, path: str, query: list[str], stem: bool = True, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(doc_id, score): BM25 of the documents of an index that hold any query term, from the postings of these terms alone."""
    terms = list(dict.fromkeys(query))
    if stem and terms:
        terms = list(dict.fromkeys(spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "i int, t string").orderBy("i").select(light_stem(F.col("t")).alias("t")).toPandas()["t"]))
    total = spark.read.parquet(f"{path}/totals").agg(F.sum("docs").alias("n"), F.sum("length").alias("length")).first()
    df = {r.term: r.df for r in term_stats(spark, path, terms).collect()} if terms else {}
    mean = (total.length or 0) / (total.n or 1) or 1.0
    idf = F.lit(0.0)
    for t, n in df.items():
        idf = F.when(F.col("term") == t, math.log(1 + (total.n - n + 0.5) / (n + 0.5))).otherwise(idf)
    hits = _of_terms(spark.read.parquet(f"{path}/postings"), list(df)) if df else spark.read.parquet(f"{path}/postings").limit(0)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(float(mean))))
    return hits.groupBy("doc_id").agg(F.sum(part).alias("score"))


def _scored(docs: DataFrame, terms: list[str], prefixes: bool, stem: bool, whole: str, width: int, k1: float, b: float) -> tuple[DataFrame, int]:
    """docs(doc_id, text) as (doc_id, tf, score), with width > 0 also (snippet, whole), and how many hold all terms; each text is read once, then one row of totals."""
    t = tokens(F.coalesce("text", F.lit("")))
    # stems take off Arabic letters alone, so most texts in other scripts are spared them
    t = F.when(F.col("text").rlike(r"[\u0600-\u06FF]"), F.transform(t, light_stem)).otherwise(t) if stem else t
    wanted = [light_stem(F.lit(q)) if stem else F.lit(q) for q in terms]
    hit = lambda x, q: F.startswith(x, q) if prefixes else x == q

    def some(x: Column) -> Column:
        out = F.lit(False)
        for q in wanted:
            out = out | hit(x, q)
        return out

    shown = [F.contains(search_form(F.coalesce("text", F.lit(""))), F.lit(whole)).alias("whole")] if width else []
    base = docs.select("doc_id", t.alias("t"), *shown)
    held = lambda q: F.size(F.filter("t", lambda x: hit(x, q)))
    tf = F.array(*[held(q) for q in wanted]).cast("array<int>")
    start = F.greatest(F.array_position(F.transform("t", some), F.lit(True)).cast("int") - width // 2, F.lit(1))
    table = shared_table(base.select("doc_id", F.size("t").alias("length"), tf.alias("tf"), *([F.array_join(F.slice("t", start, width), " ").alias("snippet"), "whole"] if width else [])))
    every, rows = F.forall("tf", lambda n: n > 0) & (F.size("tf") > 0), F.col("length") > 0
    sums = table.agg(F.count_if(rows).alias("n"), F.avg(F.when(rows, F.col("length"))).alias("mean"), F.count_if(every).alias("all"), *[F.count_if(F.get("tf", F.lit(i)) > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        n, idf = F.get("tf", F.lit(i)), math.log(1 + (sums.n - sums[f"df{i}"] + 0.5) / (sums[f"df{i}"] + 0.5))
        score = score + F.lit(idf) * n * (k1 + 1) / (n + k1 * (1 - b + b * F.col("length") / F.lit(float(sums.mean or 1))))
    return table.withColumn("score", score), sums["all"]


def bm25_texts(docs: DataFrame, query: list[str], stem: bool = True, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(doc_id, score) of docs(doc_id, text) with any query term, straight from the texts: nothing is shuffled but one row of totals."""
    table, _ = _scored(docs, list(dict.fromkeys(query)), False, stem, "", 0, k1, b)
    return table.where(F.exists("tf", lambda n: n > 0)).select("doc_id", "score")


def ranked_search(docs: DataFrame, query: str, k: int = 400, width: int = 14) -> DataFrame:
    """(doc_id, score, snippet): documents in which each token of two characters or more of the query begins some token, best first.

    Ranks are BM25 over the prefixes, snippets `width` tokens around the first hit. Where no document has all tokens, those
    that hold the whole query in its normal form are given, with score 0 and no snippet. A query without tokens finds nothing.
    """
    row = docs.sparkSession.range(1).select(tokens(F.lit(query)).alias("t"), F.trim(search_form(F.lit(query))).alias("q")).first()
    table, full = _scored(docs, list(dict.fromkeys(row.t)), True, False, row.q, width, 1.5, 0.75)
    score, snippet = F.round("score", 6).alias("score"), F.col("snippet")
    if full or not row.t:
        table = table.where(F.forall("tf", lambda n: n > 0) & (F.size("tf") > 0))
    else:
        table, score, snippet = table.where("whole"), F.lit(0.0).alias("score"), F.lit("").alias("snippet")
    return table.select("doc_id", score, snippet).orderBy(F.desc("score"), "doc_id").limit(k)


def boolean_search(docs: DataFrame, terms=(), phrases=(), nots=(), mode: str = "and") -> DataFrame:
    """Documents whose normal form holds all (or any) of terms and phrases and none of nots; with nots alone, all others."""
    text = search_form(F.col("text"))
    has = lambda t: F.contains(text, search_form(F.lit(t)))
    wanted = [has(t) for t in (*terms, *phrases)]
    cond = F.lit(True)
    if wanted:
        cond = wanted[0]
        for w in wanted[1:]:
            cond = cond & w if mode == "and" else cond | w
    for t in nots:
        cond = cond & ~has(t)
    return docs.where(cond)


def prefix_search(index: DataFrame, query: list[str], k: int = 400) -> DataFrame:
    """(doc_id, hits): documents in which each query token begins some term; most occurrences first."""
    spark: SparkSession = index.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(q,) for q in dict.fromkeys(query)], "q string"))
    hits = index.join(wanted, F.startswith("term", "q")).groupBy("doc_id").agg(F.countDistinct("q").alias("n"), F.sum("tf").alias("hits"))
    return hits.where(F.col("n") == len(set(query))).drop("n").orderBy(F.desc("hits"), "doc_id").limit(k)


def word_families(docs: DataFrame, k: int = 3) -> DataFrame:
    """Occurrences and documents for each stem, with sample forms."""
    both = F.sort_array(F.transform("words", lambda t: F.struct(light_stem(t).alias("stem"), t.alias("form"))))
    rows = _words(docs, tokens(F.col("text"))).select(both.alias("w"))
    marked = F.transform("w", lambda p, i: F.struct(p.alias("p"), ((i == 0) | (p["stem"] != F.get("w", F.greatest(i - 1, F.lit(0)))["stem"])).cast("long").alias("first")))
    forms = rows.select(F.explode(marked).alias("x")).groupBy("x.p.stem", "x.p.form").agg(F.count("*").alias("n"), F.sum("x.first").alias("docs"))
    return forms.groupBy("stem").agg(F.sum("n").alias("times"), F.sum("docs").alias("docs"), F.slice(F.array_sort(F.collect_list("form")), 1, k).alias("forms"))


def expand_terms(query: DataFrame, morph: DataFrame) -> DataFrame:
    """query(term) with all terms that share a root in morph(term, root)."""
    roots = query.join(morph, "term").select("root").distinct()
    return query.select("term").union(morph.join(roots, "root").select("term")).distinct()
