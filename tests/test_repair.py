"""Fixtures for the repair operators and the reports that SQL does not cover."""

from pyspark.sql import functions as F

from scriptorium.operators import lines, repair, reports


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


def one(spark, column, s):
    return spark.createDataFrame([(s,)], "s string").select(column(F.col("s")).alias("x")).first().x


def test_reversal_keeps_numbers(spark):
    assert one(spark, repair.reversed_line, "(أ) 123/45 مقر") == "رقم 123/45 (أ)"
    assert one(spark, repair.reversed_line, "") == ""


def test_direction(spark):
    ls = lines.lines(docs(spark, "مقر ىوعدلا\nرقم الدعوى\nabc"))
    got = {r.line_no: (r.line, r.changed) for r in repair.repair_direction(ls, ["رقم", "الدعوى"]).collect()}
    assert got == {1: ("الدعوى رقم", True), 2: ("رقم الدعوى", False), 3: ("abc", False)}
    careful = repair.repair_direction(ls, ["رقم", "الدعوى"], conservative=True)
    assert not any(r.changed for r in careful.collect())


def test_doubling(spark):
    assert one(spark, repair.collapse_doubling, "abc abc abc de") == "abc de"
    assert one(spark, repair.collapse_doubling, "محكممحكم x x 121212") == "محكم x x 121212"


def test_paragraphs(spark):
    text = "TITLE\nshort one.\nlong enough to close the paragraph right here.\nnext\nnext\n***\n\nsame\n\n\nlast"
    got = [(r.kind, r.text) for r in repair.rebuild_paragraphs(docs(spark, text, ""), "[A-Z]{3,}$").orderBy("para_no").collect()]
    assert got == [("heading", "TITLE"), ("para", "short one. long enough to close the paragraph right here."), ("para", "next same"), ("para", "last")]


def test_zones(spark):
    text = "[صفحة 1]\nHead\nThis line has more than twenty letters in it\nshort\nfoot\n[صفحة 2]\nHead\nThis line has more than twenty letters in it\nend"
    got = {r.line_no: r.zone for r in repair.header_zones(lines.lines(docs(spark, text)), body="^BODY").collect()}
    assert got == {1: "mark", 2: "header", 3: "body", 4: "footer", 5: "footer", 6: "mark", 7: "header", 8: "body", 9: "body"}


def test_cards_and_merge(spark):
    d = spark.createDataFrame([(1, "case 12345678", "Court A\nno 777"), (2, "", None)], "doc_id long, title string, text string")
    cards = reports.build_cards(d, ["Court A"], {"title:case": r"(\d{8})", "case": r"no (\d+)", "number": r"no (\d+)"})
    got = {r.doc_id: r.card for r in cards.collect()}
    assert got == {1: {"authority": "Court A", "case": "12345678", "number": "777"}, 2: {}}
    external = spark.createDataFrame([(1, {"case": "9", "number": None})], "doc_id long, card map<string,string>")
    merged = {r.doc_id: r.card for r in reports.merge_cards(cards, external).collect()}
    assert merged == {1: {"authority": "Court A", "case": "9", "number": "777"}, 2: {}}


def test_figures(spark):
    text = "total 1,250,000 and 12\n3 USD\n123456 on 01/02/2020"
    got = reports.financial_figures(lines.lines(docs(spark, text)), "USD", "total").collect()
    assert sorted((r.line_no, r.digits, r.unit) for r in got) == [(1, "1250000", ""), (2, "3", "USD")]


def test_milestones(spark):
    d = spark.createDataFrame([(1, "ruling 1432-07-01"), (2, "ruling 1432-07-01"), (3, "ruling"), (4, "letter"), (5, "ruling 1431-01-01")], "doc_id long, title string")
    assert [(r.doc_id, r.date_key) for r in reports.milestones(d, "ruling").collect()] == [(5, 14310101), (1, 14320701), (3, None)]
