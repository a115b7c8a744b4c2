"""Timelines across calendars, highlights on texts with marks, inventories."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from scriptorium.functions.text import date_to_hijri, hijri_to_date
from scriptorium.operators import package


def test_calendars_round_trip(spark):
    days = spark.range(0, 40_000, 7).select(F.date_add(F.lit("1920-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    both = days.select("d", date_to_hijri(F.col("d")).alias("key"))
    assert both.where(hijri_to_date(F.col("key")) != F.col("d")).count() == 0
    assert both.where("key % 100 not between 1 and 30 or key div 100 % 100 not between 1 and 12").count() == 0
    assert both.where(F.col("d") == F.lit(date(1920, 1, 1) + timedelta(7))).first().key == 13380416


def test_unified_timeline(spark):
    rows = [(2, "b", "letter", "p", "on 5/3/1999 and 5-3-1999, again 5/3/1999"), (1, "a", "deed", "q", "1/1/1420"), (3, "b", "memo", "r", "5/3/1999"), (4, "c", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, doc_type string, path string, text string")
    got = [(r.calendar, r.value, r.title, r.doc_type, r.date_key) for r in package.unified_timeline(docs).collect()]
    assert got == [("gregorian", "5-3-1999", "b", "letter", 19990305), ("gregorian", "5/3/1999", "b", "letter", 19990305), ("hijri", "1/1/1420", "a", "deed", 14200101)]


def test_highlights(spark):
    docs = spark.createDataFrame([(1, "إِسْلام والاسلام"), (2, "banana ANA"), (3, ""), (4, None), (5, "a.b axb")], "doc_id long, text string")
    got = sorted(map(tuple, package.highlights(docs, ["اسلام"]).collect()))
    assert got == [(1, 0, 7), (1, 11, 16)]
    assert sorted(map(tuple, package.highlights(docs, ["ana", "nan"]).collect())) == [(2, 1, 5), (2, 7, 10)]
    assert sorted(map(tuple, package.highlights(docs, ["a.b"]).collect())) == [(5, 0, 3)]


def test_inventory_and_quality(spark):
    tree = spark.createDataFrame([("/x/one/a.PDF", 3), ("/x/one/d/b.txt", 4), ("/x/two/c", 5), ("/x/loose.txt", 9)], "path string, size long")
    got = {r.archive: (r.files, r.bytes) for r in package.inner_inventory(package.inner_files(tree, "/x")).collect()}
    assert got == {"one": (2, 7), "two": (1, 5), None: (3, 12)}
    none = spark.createDataFrame([], "n_pages long, blank_pages long, distorted boolean, needs_review boolean, date string, url string, text string, has_marks boolean")
    row = package.package_quality(none, none).first()
    assert row.docs == 0 and row.pages == 0 and row.duplicate_pairs == 0
