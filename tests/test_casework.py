"""Operators for a case's documents that SQL tests do not reach: edge cases, Arabic forms, exports, formulas."""

from pyspark.sql import functions as F

from scriptorium.functions import text
from scriptorium.operators import casework as c
from scriptorium.operators import lines, reports
from scriptorium.plans import casework as queries


def test_articles_and_numbers(spark):
    docs = spark.createDataFrame([(1, "المادة رقم (١٢) والمادة 7"), (2, "مادة 7 مادة 7"), (3, None), (4, "")], "doc_id long, text string")
    assert {tuple(r) for r in c.extract_articles(docs).collect()} == {(1, 12), (1, 7), (2, 7)}
    assert {tuple(r) for r in c.match_known_numbers(docs, ["12", "7", "99"]).collect()} == {(1, "12"), (1, "7"), (2, "7")}


def test_letters_stems_and_ratio(spark):
    one = spark.range(1)
    assert one.select(text.clean_letters(F.lit("ھہۀۃیۍک"))).first()[0] == "هههةييك"
    assert [one.select(text.light_stem(F.lit(w))).first()[0] for w in ("والكتاب", "كتابها", "مدرسيه")] == ["كتاب", "كتاب", "مدرس"]
    files = spark.createDataFrame([(1, "ﺏ........", "ok", "txt")], "doc_id int, text string, read_status string, fileExtension string")
    assert reports.readability_flags(files).first().orientation == "visual"


def test_fragments_are_short_lines(spark):
    q = lines.quality_metrics(spark.createDataFrame([(1, "ab\nالحكم")], "doc_id int, text string")).first()
    assert q.fragments == 0.5 and q.line_ratio == 0.5


def test_missing_and_variants(spark):
    texts = spark.createDataFrame([("a b.txt", "x" * 30), ("k1.txt", "  short "), ("k2.txt", "y"), (None, "z"), ("k1.txt", None)], "name string, text string")
    got = {r.id: r.status for r in c.index_missing(texts, spark.createDataFrame([("k2",)], "id string")).collect()}
    assert got.pop("k1") == "empty" and list(got.values()) == ["ok"] and list(got)[0].startswith("doc_")
    docs = spark.createDataFrame([(1, "", 90.0), (2, "old", 50.0), (3, "old", 50.0), (4, None, None)], "doc_id int, text string, quality double")
    new = spark.createDataFrame([(1, "new", 10.0), (2, "new", 58.0), (3, "new", 58.5)], "doc_id int, text string, quality double")
    assert {r.doc_id: (r.changed, r.text, r.old_text) for r in c.create_or_replace(docs, new, "replace").collect()} == {1: (True, "new", None), 2: (False, "old", None), 3: (True, "new", "old"), 4: (False, None, None)}
    assert {r.doc_id for r in c.create_or_replace(docs, new, "new").where("changed").collect()} == {1, 2, 3}


def test_lists_and_exports(spark, tmp_path):
    docs = spark.createDataFrame([(1, "b", 0.1, None, "y"), (2, "أ", 0.9, "2020", "x")], "doc_id int, title string, score double, date string, doc_type string")
    first = lambda by: c.sort_docs(docs, by).first().doc_id
    assert [first(b) for b in ("relevance", "date", "type")] == [2, 2, 2]
    c.export_cards(docs, f"{tmp_path}/cards", spark.createDataFrame([(2,)], "doc_id int"))
    assert spark.read.option("header", True).csv(f"{tmp_path}/cards").count() == 1
    assert c.get_doc(docs, 1).count() == 1 and "text" not in c.list_docs(docs.withColumn("text", F.lit("t"))).columns


def test_contained_edges(spark):
    docs = spark.createDataFrame([(1, "One two  three four five six"), (2, "two three"), (3, None), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "two three"), (2, "one two three four five SIX"), (3, ""), (4, None), (5, "wo three")], "item_id long, text string")
    assert {tuple(r) for r in c.contained_passages(docs, items).collect()} == {(1, 1), (2, 1), (1, 2)}


def test_most_distorted(spark):
    got = queries.most_distorted(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 40 and all(a.score >= b.score for a, b in zip(got, got[1:], strict=False))
