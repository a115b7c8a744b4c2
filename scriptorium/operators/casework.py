"""Selecting, listing and merging documents of a case: filters, registers of values, exports, and the choice between text variants."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import ascii_digits, audit_form, tokens
from scriptorium.operators.extract import held_patterns
from scriptorium.operators.pairs import set_join
from scriptorium.plans.session import shared_table

#: How an article of a law is cited, in the normal form for matching.
ARTICLE = r"(?:الماده|ماده)\s*(?:رقم\s*)?\(?\s*(\d{1,3})\)?"


def index_missing(texts: DataFrame, index: DataFrame, least: int = 20) -> DataFrame:
    """(id, name, status) for texts(name, text) without a record in index(id): id is the file's stem, or `doc_` and a digest where it has other characters than letters, digits, `_` and `-`. Empty is a text of fewer than `least` trimmed characters. Equal ids once, the first name."""
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    key = F.when(stem.rlike("^[A-Za-z0-9_-]+$"), stem).otherwise(F.concat(F.lit("doc_"), F.substring(F.md5(F.col("name").cast("binary")), 1, 16)))
    status = F.when(F.length(F.trim(F.coalesce("text", F.lit("")))) >= least, "ok").otherwise("empty")
    new = texts.where("name is not null").select(key.alias("id"), "name", status.alias("status")).groupBy("id").agg(F.min(F.struct("name", "status")).alias("x"))
    return new.join(index.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_anti").select("id", "x.name", "x.status")


def financial_docs(docs: DataFrame, types: list[str], title_pattern: str) -> DataFrame:
    """Documents of some types, or whose title matches."""
    return docs.where(F.col("doc_type").isin(types) | F.coalesce(F.col("title").rlike(title_pattern), F.lit(False)))


def filter_docs(docs: DataFrame, doc_type: str | None = None, flags: DataFrame | None = None) -> DataFrame:
    """Documents of a type (None: any) that stand in flags(doc_id) (None: any)."""
    out = docs if doc_type is None else docs.where(F.col("doc_type") == doc_type)
    return out if flags is None else out.join(flags.select("doc_id").distinct(), "doc_id", "left_semi")


def suggest_model(text: Column, amount: str, table_word: str = "جدول", least: int = 3) -> Column:
    """The reading model for a text: layout where amounts or the word for tables stand, else read."""
    text = F.coalesce(text, F.lit(""))
    return F.when((F.regexp_count(text, F.lit(amount)) >= least) | F.contains(text, F.lit(table_word)), "layout").otherwise("read")


def extract_articles(docs: DataFrame, pattern: str = ARTICLE) -> DataFrame:
    """(doc_id, article): numbers of cited articles, as integers, once each."""
    found = F.regexp_extract_all(audit_form(F.col("text")), F.lit(pattern), F.lit(1))
    return docs.select("doc_id", F.explode(F.array_distinct(found)).alias("n")).select("doc_id", F.col("n").cast("int").alias("article")).distinct()


def match_known_numbers(docs: DataFrame, numbers: list[str]) -> DataFrame:
    """(doc_id, number): known numbers that a text holds. The numbers are a small list, looked for in one pass over each text."""
    text = ascii_digits(F.col("text"))
    held = F.filter(F.array(*[F.lit(n) for n in dict.fromkeys(numbers)]), lambda n: F.contains(text, n))
    return docs.select("doc_id", F.explode(held).alias("number"))


def same_title_groups(docs: DataFrame) -> DataFrame:
    """(norm_title, docs, first_id): titles that several documents share in their normal form."""
    return docs.select("doc_id", audit_form(F.lower("title")).alias("norm_title")).where("norm_title <> ''").groupBy("norm_title").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_id")).where("docs > 1")


def match_study_lines(lines: DataFrame, titles: DataFrame, least: float = 0.45) -> DataFrame:
    """For each of lines(line_id, line) the first of titles(title_id, title) whose words reach the Jaccard similarity; (line_id, title_id, similarity).

    Lines, and titles, with the same words are one (the titles' first id). Word sets meet by a prefix filter on both sides: rare
    words first, and only as many of a set as a partner of the least size can leave out. Lines and titles without words match nothing.
    """
    words = lambda df, key, col: df.select(F.col(key).alias("id"), F.array_sort(F.array_distinct(tokens(F.col(col), 1))).alias("items")).where(F.size("items") > 0)
    a, b = words(lines, "line_id", "line"), words(titles, "title_id", "title")
    once = lambda df: df.groupBy("items").agg(F.min("id").alias("id"))
    close = set_join(once(a), once(b), "id", F.col("items"), least)
    best = close.groupBy("a").agg(F.min(F.struct(F.col("b").alias("title_id"), "similarity")).alias("x"))
    first = once(a).join(best, F.col("id") == F.col("a")).select("items", "x")
    return a.join(first, "items").select(F.col("id").alias("line_id"), "x.*")


def contained_passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): items whose whole text stands in a document, as runs of words at single blanks, in lower case.

    All items are looked for in one pass over each text (see held_patterns), so nothing is joined or shuffled. Items without
    words stand nowhere.
    """
    words = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), F.lit(" "))
    wanted = items.select("item_id", words(F.col("text")).alias("pattern")).where("trim(pattern) <> ''")
    return held_patterns(docs.select("doc_id", words(F.col("text")).alias("text")), wanted).select("doc_id", "item_id")


def hits_with_docs(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Search hits with their documents' columns."""
    return hits.join(docs, "doc_id")


def hit_count(index: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, hits): occurrences of the terms in each document of postings(term, doc_id, tf)."""
    return index.where(F.col("term").isin(list(terms))).groupBy("doc_id").agg(F.sum("tf").alias("hits"))


def ingest_tally(log: DataFrame) -> DataFrame:
    return log.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("docs"))


def section_order(docs: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """Adds place: the order of documents by path and title within their section, from 1; with `keep`, to these columns alone.

    All documents are sorted once, in ranges, and written with their number in that order. A section's rows follow one another in
    each range, so a place is the distance from the first of them, plus the section's rows in ranges before: no task holds more of
    a section than its range.
    """
    order = [F.col("section").asc_nulls_first(), F.col("path").asc_nulls_first(), F.col("title").asc_nulls_first(), "doc_id"]
    columns = list(docs.columns if keep is None else keep)
    rows = docs.orderBy(*order).select(*columns, F.col("section").alias("_section"), F.monotonically_increasing_id().alias("_at"))
    rows = shared_table(rows.withColumn("_range", F.shiftright("_at", 33)))
    parts = rows.groupBy("_section", "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("_section").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select(F.col("_section").alias("_s"), F.col("_range").alias("_r"), (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    placed = rows.join(starts, (F.col("_range") == F.col("_r")) & F.col("_section").eqNullSafe(F.col("_s")))
    return placed.select(*columns, (F.col("_at") + F.col("_shift")).cast("int").alias("place"))


def top_amounts(amounts: DataFrame, k: int = 20, least_digits: int = 4) -> DataFrame:
    """(value, docs): the largest of amounts(doc_id, value) with enough digits."""
    return amounts.where(F.length(F.col("value").cast("string")) >= least_digits).groupBy("value").agg(F.countDistinct("doc_id").alias("docs")).orderBy(F.desc("value")).limit(k)


def sort_docs(docs: DataFrame, by: str, locale: str = "ar") -> DataFrame:
    """Documents by relevance (falling score), date, type or title (in the order of a language)."""
    key = {"relevance": F.desc_nulls_last("score"), "date": F.asc_nulls_last("date"), "type": F.asc_nulls_last("doc_type")}.get(by)
    return docs.orderBy(F.collate(F.col("title"), locale) if key is None else key, "doc_id")


def worst_distortion(scores: DataFrame, k: int) -> DataFrame:
    """The k documents with the highest distortion score."""
    return scores.orderBy(F.desc("score"), "doc_id").limit(k)


def known_ids(*frames: DataFrame) -> DataFrame:
    """(id): ids of any of the tables, once each."""
    return reduce(DataFrame.union, [f.select(F.col("id").cast("string").alias("id")) for f in frames]).where("id is not null").distinct()


def merge_lexicons(*lexicons: DataFrame) -> DataFrame:
    """(kind, label, pattern) of several lexicons; of equal patterns of a kind the earlier lexicon's label stands."""
    parts = [x.select("kind", "label", "pattern", F.lit(i).alias("n")) for i, x in enumerate(lexicons)]
    return reduce(DataFrame.union, parts).groupBy("kind", "pattern").agg(F.min(F.struct("n", "label")).alias("x")).select("kind", "x.label", "pattern")


def get_doc(docs: DataFrame, doc_id) -> DataFrame:
    return docs.where(F.col("doc_id") == doc_id)


def list_docs(docs: DataFrame) -> DataFrame:
    """All documents without their texts, in order."""
    return docs.drop("text").orderBy("doc_id")


def export_cards(cards: DataFrame, path: str, scope: DataFrame | None = None) -> None:
    """Write the cards, or those that stand in scope(doc_id), as CSV with a header."""
    (cards if scope is None else cards.join(scope.select("doc_id").distinct(), "doc_id", "left_semi")).write.option("header", True).csv(path)


def keep_denser(docs: DataFrame, candidates: DataFrame, factor: float = 1.02, least: int = 50) -> DataFrame:
    """docs(doc_id, text, density) with adopted and text: a candidate(doc_id, text, density) is adopted if it is at least `factor` times as dense and longer than `least` trimmed characters."""
    new = candidates.select("doc_id", F.col("text").alias("new_text"), F.col("density").alias("new_density"))
    adopt = F.coalesce((F.col("new_density") >= F.col("density") * factor) & (F.length(F.trim("new_text")) > least), F.lit(False))
    both = docs.join(new, "doc_id", "left").withColumn("adopted", adopt)
    return both.withColumns({"text": F.when(F.col("adopted"), F.col("new_text")).otherwise(F.col("text")), "density": F.when(F.col("adopted"), F.col("new_density")).otherwise(F.col("density"))}).drop("new_text", "new_density")


def create_or_replace(docs: DataFrame, candidates: DataFrame, mode: str, delta: float = 8.0) -> DataFrame:
    """docs(doc_id, text, quality) with changed and old_text: mode "new" takes any candidate with text, "replace" one that is better by more than delta."""
    new = candidates.select("doc_id", F.col("text").alias("new_text"), F.col("quality").alias("new_quality"))
    old_quality = F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.col("quality")).otherwise(0.0)
    take = F.trim("new_text") != "" if mode == "new" else F.col("new_quality") - old_quality > delta
    both = docs.join(new, "doc_id", "left").withColumn("changed", F.coalesce(take, F.lit(False)))
    kept = F.when(F.col("changed") & (F.trim(F.coalesce("text", F.lit(""))) != ""), F.col("text"))
    return both.withColumn("old_text", kept).withColumns({"text": F.when(F.col("changed"), F.col("new_text")).otherwise(F.col("text")), "quality": F.when(F.col("changed"), F.col("new_quality")).otherwise(F.col("quality"))}).drop("new_text", "new_quality")


def compare_variants(qualities: DataFrame, first: str, second: str, delta: float = 2.0) -> DataFrame:
    """(doc_id, the two variants' qualities, difference, winner) of qualities(doc_id, variant, quality); a winner is better by more than delta."""
    side = qualities.groupBy("doc_id").pivot("variant", [first, second]).agg(F.max("quality"))
    d = F.col(second) - F.col(first)
    return side.withColumn("difference", d).withColumn("winner", F.when(d > delta, second).when(d < -delta, first))


def card_json(*columns: str) -> Column:
    """A card as JSON text; nulls are left out."""
    return F.to_json(F.struct(*columns))


def card_of_json(text: Column, schema: str) -> Column:
    """The struct (a DDL schema) of a card's JSON text: fields that are missing or of another type are null, and so is what is no JSON object at all."""
    return F.when(F.get_json_object(text, "$").rlike(r"^\s*\{"), F.from_json(text, schema, {"mode": "PERMISSIVE"}))
