"""URL filters (operator 4): rules by host and path first, gradient-boosted trees on lexical features for the rest.

Urls that a rule decides are the labelled urls that the trees are trained on.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: (verdict, host, path): fits the host and its subdomains if the url's path starts with the rule's.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Bound: labelled urls, or so, that the trees are trained on; trees and their depth.
FIT_ROWS, TREES, DEPTH = 20_000, 12, 4
#: Suffixes whose rates are sent to all tasks; more of them are joined by shuffle.
SUFFIXES = 50_000
FEATURES = ["url_length", "host_length", "host_labels", "path_depth", "digit_ratio", "entropy", "parameters", "hyphens", "longest_label", "suffix_rate"]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and where `://` is missing."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    rest = F.coalesce(rest, F.lit(""))
    # translate() keeps letters other than A-Z as they are
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """Rule string and verdict of the longest rule that fits host and path (of equally long ones the first)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the lexical features of url, host and path, and the host's suffix."""
    url = F.coalesce(F.col("url"), F.lit(""))
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    share = lambda c: (F.length(url) - F.length(F.replace(url, c))) / size
    entropy = F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), lambda acc, c: acc - F.when(F.length(c) > 0, share(c) * F.log2(F.greatest(share(c), 1e-12 + 0 * size))).otherwise(0.0))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    return urls.withColumns(
        {
            "url_length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "host_labels": F.size(labels).cast("double"),
            "path_depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
            "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / size,
            "entropy": entropy,
            "parameters": F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double"),
            "hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
            "longest_label": F.array_max(F.transform(labels, F.length)).cast("double"),
            "suffix": F.element_at(labels, -1),
        }
    )


def judge_urls(urls: DataFrame, rules=RULES, fit_rows: int = FIT_ROWS, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """Adds host, path, rule, verdict and block_score to urls(.., url).

    A rule's verdict stands; block_score (1: surely block) is the trees' and decides at 0.5 where no rule fits. Null urls and
    urls without `://` have empty host and path and no rule. Without labelled urls of both verdicts there is nothing to train on:
    then block_score is 1 if only blocked urls are known, else 0. Rows are judged one by one, repeats alike; other columns pass
    through, columns named like the new ones are replaced; an empty table gives an empty table.
    """
    new = ["host", "path", "rule", "verdict", "block_score"]
    columns = [c for c in urls.columns if c not in new]
    host, path = split_url(F.col("url"))
    rule, verdict = rule_columns(rules)
    # rows travel as structs, so that their columns' names meet none of the features'
    marked = urls.select(F.struct(*columns).alias("row"), F.col("url").alias("url"), host.alias("host"), path.alias("path")).withColumns({"rule": rule, "_by_rule": verdict})
    known = marked.where("rule is not null").select("url", "host", "path", (F.col("_by_rule") == "block").cast("double").alias("label")).dropDuplicates(["url"])
    # statistics of suffixes are of all labelled urls; the trees are trained on a bounded sample of them
    suffix = F.element_at(F.split("host", r"\."), -1)
    by_suffix = cut(known.groupBy(suffix.alias("suffix")).agg(((F.sum("label") + 1) / (F.count("*") + 2)).alias("suffix_rate"), F.count("*").alias("urls"), F.sum("label").alias("blocked")))
    few = by_suffix.count() <= SUFFIXES
    rates = by_suffix.select("suffix", "suffix_rate")
    rated = lambda df: df.join(F.broadcast(rates) if few else rates, "suffix", "left").fillna(0.5, ["suffix_rate"])
    totals = by_suffix.agg(F.sum("urls").alias("n"), F.sum("blocked").alias("blocked")).first()
    n, blocked = totals.n or 0, totals.blocked or 0
    if n > fit_rows:
        known = known.where(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < int(1e6 * fit_rows / n))
    final = F.coalesce("_by_rule", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    train = rated(lexical(known)).coalesce(8).persist(StorageLevel.MEMORY_AND_DISK)
    if not 0 < blocked < n or train.select("label").distinct().count() < 2:
        out = marked.withColumn("block_score", F.lit(1.0 if n and blocked * 2 > n else 0.0))
    else:
        assemble = VectorAssembler(inputCols=FEATURES, outputCol="_features")
        model = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=trees, maxDepth=depth, seed=1, predictionCol="_prediction").fit(assemble.transform(train).select("_features", "label"))
        model.setRawPredictionCol("_raw").setProbabilityCol("_probability")
        scored = model.transform(assemble.transform(rated(lexical(marked))))
        out = scored.withColumn("block_score", vector_to_array("_probability")[1])
    train.unpersist()
    return out.withColumn("verdict", final).select(*[F.col("row").getField(c).alias(c) for c in columns], *new)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "block_score")
