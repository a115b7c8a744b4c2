"""Arabic fixtures and properties of the audit operators; the registered queries are held against SQL in test_oracle.py."""

import datetime
import json

from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import extract, lines, pairs, registers, search
from scriptorium.sources import files
from scriptorium.streaming import incremental


def value(spark, column, s):
    return spark.createDataFrame([(s,)], "s string").select(column(F.col("s")).alias("x")).first().x


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


def test_normal_forms(spark):
    assert value(spark, lambda c: T.audit_form(c, compatibility=True), "ﻻ ٣٤") == "لا 34"
    assert value(spark, T.search_form, "أحكامُ الدائرة") == "احكام الدايره"
    assert value(spark, T.light_stem, "والمحكمه") == "محكم"
    assert value(spark, T.hijri_key, "7/11/1432") == 14321107
    assert value(spark, T.hijri_key, "1433-01-05") == 14330105
    assert value(spark, T.hijri_key, "none") is None
    assert value(spark, lambda c: T.hijri_to_date(T.hijri_key(c)), "1432-07-01") == datetime.date(2011, 6, 3)
    assert value(spark, T.file_id, "https://x.example/d/abc_1/view") == "abc_1"


def test_extraction(spark):
    assert value(spark, extract.long_numbers, "رقم123456 و 7654321") == ["7654321"]
    assert value(spark, lambda c: extract.dates(c, extract.HIJRI), "بتاريخ 7/11/1432 ثم 1433-01-05 وايداع 2011/06/03") == ["7/11/1432", "1433-01-05"]
    rows = extract.extract_amounts(docs(spark, "مبلغ 1,250,000 ريال و 300 ريال")).collect()
    assert [(r.amount_key, int(r.amount_value)) for r in rows] == [("1250000", 1250000)]
    lexicon = spark.createDataFrame([("court", "A", "محكمة")], "kind string, label string, pattern string")
    assert extract.match_aliases(docs(spark, "في محكمة جدة", "ةمكحم", "x"), lexicon).count() == 2


def test_pages(spark):
    pages = lines.split_pages(docs(spark, "أ\n[صفحة 1]\nنص\n[صفحة 2]\nنص", "plain"))
    assert sorted((r.doc_id, r.page_no) for r in pages.collect()) == [(1, 0), (1, 1), (1, 2), (2, 1)]
    three = docs(spark, "a", "", "[صفحة 1]\nx\n[صفحة 2]\ny")
    out = registers.page_ranges(three, "doc_id", lines.page_estimate(F.col("text"))).orderBy("doc_id").collect()
    assert [(r.page_from, r.page_to) for r in out] == [(1, 1), (2, 2), (3, 4)]


def test_quality_and_lines(spark):
    q = lines.quality_metrics(docs(spark, "الحكم\nabc\n12")).first()
    assert (q.quality, q.risk) == (49.4, 50.6)
    kept = lines.drop_repeats(lines.lines(docs(spark, "a\n\nA \nb\na"))).collect()
    assert [r.line_no for r in sorted(kept, key=lambda r: r.line_no)] == [1, 4, 5]
    hits = lines.kwic(docs(spark, "one Two three two"), "two", 4, 4).orderBy("pos").collect()
    assert [r.pos for r in hits] == [4, 14] and hits[0].context == "one Two thr"


def test_capture_stops_at_blank(spark):
    text = "GROUNDS\nfirst long enough line\nsecond long enough line\n\nthird long enough line"
    got = extract.capture_after(docs(spark, text), [("^GROUNDS", "grounds")]).collect()
    assert sorted(r.line_no for r in got) == [2, 3]


def test_bm25_by_hand(spark):
    index = spark.createDataFrame([("x", 1, 2), ("y", 1, 2), ("y", 2, 4), ("y", 3, 4)], "term string, doc_id long, tf long")
    assert round(search.bm25(index, ["x"]).first().score, 4) == round(0.980829253 * 2 * 2.5 / (2 + 1.5), 4)


def test_reconcile_and_sets(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert {r.id: r.found for r in pairs.reconcile(ids(1, 2), ids(2, 3), "id").collect()} == {1: "study", 2: "both", 3: "archive"}
    titles = spark.createDataFrame([(1, "a b c d"), (2, "a b c e"), (3, "x y"), (4, "a b c d")], "doc_id long, title string")
    assert [(r.a, r.b, r.similarity) for r in pairs.similar_titles(titles, 0.6).collect()] == [(1, 2, 0.6)]


def test_running_total_is_exact(spark):
    df = spark.range(1, 501).withColumn("size", F.col("id") % 7)
    got = registers.running_total(df, "id", F.col("size"), "total", rows_a_range=63).orderBy("id").collect()
    total = 0
    for r in got:
        total += r["size"]
        assert r.total == total


def test_keep_best(spark):
    base = spark.createDataFrame([(1, 50.0, False), (2, 50.0, False), (3, 70.0, False), (4, 10.0, False)], "doc_id long, quality double, replaced boolean")
    new = spark.createDataFrame([(1, 58.0), (2, 58.1), (3, 99.0)], "doc_id long, quality double")
    assert {r.doc_id: r.decision for r in incremental.keep_best(base, new).collect()} == {1: "kept", 2: "replaced", 3: "skipped", 4: "missing"}


def test_ingest_stream_twice(spark, tmp_path):
    src, target, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    a = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, title string")
    b = spark.createDataFrame([("2", "c"), ("3", "d"), ("3", "e")], "id string, title string")
    a.write.mode("append").parquet(src)
    incremental.ingest_stream(spark, src, a.schema, target, ck)
    b.write.mode("append").parquet(src)
    for _ in range(2):
        incremental.ingest_stream(spark, src, a.schema, target, ck)
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == ["1", "2", "3"]


def test_file_index(spark, tmp_path):
    for name, rows in (("clean", [{"id": "1", "title": "kept"}]), ("parts", [{"id": "1", "title": "late"}, {"title": "no id"}])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.jsonl").write_text("\n".join(map(json.dumps, rows)) + ("\n{broken" if name == "parts" else ""))
    good, bad = files.read_file_index(spark, str(tmp_path / "clean"), str(tmp_path / "parts"))
    assert sorted((r.id or "", r.title) for r in good.collect()) == [("", "no id"), ("1", "kept")]
    assert bad.count() == 1
