"""Operators that no registered query calls, each on a small fixture."""

import json

from pyspark.sql import functions as F

from scriptorium.functions import text
from scriptorium.operators import casework, extract, lines, pairs, registers, repair, reports, search
from scriptorium.sources import files
from scriptorium.streaming import incremental


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def lines_of(spark, *texts):
    return lines.lines(table(spark, list(enumerate(texts)), "doc_id long, text string"))


def test_texts_by_precedence(spark):
    index = table(spark, [("1", "f1"), ("2", "f2"), ("3", "f3"), ("4", None), (None, "f1")], "id string, text_file string")
    repaired, raw = table(spark, [("1", "repaired")], "id string, text string"), table(spark, [("1", "raw"), ("2", "raw"), ("3", "raw")], "id string, text string")
    named = table(spark, [("f1", "named"), ("f2", ""), ("f3", None)], "text_file string, text string")
    got = {r.id: r.text for r in files.attach_text(index, repaired, raw, named).collect()}
    assert got == {"1": "repaired", "2": "", "3": "raw", "4": "", None: "named"}
    assert {r.id: r.text for r in files.attach_text(index, repaired, raw).collect()} == {"1": "repaired", "2": "raw", "3": "raw", "4": "", None: ""}


def test_enrich_and_paths(spark):
    index = table(spark, [("1", None, "", "p1", None), ("2", "own", "p2", "p2", None), ("3", "t", "a/b", "p1", None)], "id string, title string, parent_path string, parentId string, text_file string")
    meta, folders = table(spark, [("1", "given", 7), ("2", "other", None)], "id string, title string, size int"), table(spark, [("p1", "One"), ("p2", "Two")], "id string, title string")
    none = table(spark, [], "id string, text string")
    got = {r.id: (r.title, r.parent_path, r["size"], r.text) for r in files.enrich(index, meta, folders, none, none).collect()}
    assert got == {"1": ("given", "One", 7, ""), "2": ("own", "Two", None, ""), "3": ("t", "a/b", None, "")}


def test_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.PDF").write_bytes(b"123")
    (tmp_path / "y").write_bytes(b"")
    (tmp_path / "z").write_bytes(b"1")
    got = {(r.path.rsplit("/", 1)[1], r.extension, r["size"]) for r in files.read_tree(spark, str(tmp_path)).collect()}
    assert got == {("x.PDF", "pdf", 3), ("z", "", 1)}  # empty files are not listed


def test_lexicons_with_defaults(spark, tmp_path):
    conf = {"case": {"number": "12", "other_numbers": ["13"], "title": "T"}, "parties": {"A": ["a1", "a2"], "B": ["b"]}, "courts": {}, "company_patterns": ["co"], "deed_numbers_known": []}
    (tmp_path / "good.json").write_text(json.dumps(conf, indent=1))
    (tmp_path / "bad.json").write_text("{no json")
    defaults = table(spark, [(k, "d", "d", 0) for k in ("parties", "courts", "deed", "law", "title", "folder")], "kind string, label string, pattern string, ord int")
    got = sorted(map(tuple, files.load_lexicons(spark, [f"{tmp_path}/absent.json", f"{tmp_path}/bad.json", f"{tmp_path}/good.json"], defaults).collect()))
    assert got == [("case", "12", "12", 0), ("case", "13", "13", 1), ("company", "co", "co", 0), ("folder", "d", "d", 0), ("law", "d", "d", 0), ("parties", "A", "a1", 0), ("parties", "A", "a2", 0), ("parties", "B", "b", 1), ("title", "T", "T", 0)]
    assert files.load_lexicons(spark, [f"{tmp_path}/bad.json"], defaults).count() == 6
    assert files.load_lexicons(spark, []).count() == 0


def test_quality_list_by_header_parts(spark, tmp_path):
    (tmp_path / "q.csv").write_text("﻿اسم الملف,عدد الأسطر,أسطر معكوسة,الحالة العامة\n one ,9,3 lines,clean\ntwo,1,,noisy\none,2,٤,reversed\n,1,1,x\n", encoding="utf-8")
    got = {r.title: (r.status, r.reversed_lines, r.words) for r in files.read_qc(spark, str(tmp_path / "q.csv")).collect()}
    assert got == {"one": ("reversed", 0, None), "two": ("noisy", 0, None)}


def test_registers_are_marked(spark, tmp_path):
    df = table(spark, [(1, "x")], "doc_id long, value string")
    files.write_register(df, f"{tmp_path}/c")
    files.write_register(df, f"{tmp_path}/p", "parquet")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").first().asDict() == {"doc_id": "1", "value": "x", "made_by": "script", "needs_review": "true"}
    assert spark.read.parquet(f"{tmp_path}/p").first().needs_review is True


def test_update_as_new_version(spark, tmp_path):
    docs, changes = table(spark, [(1, "a"), (2, "b")], "doc_id long, text string"), table(spark, [(2, "c")], "doc_id long, text string")
    target = incremental.apply_update(docs, changes, str(tmp_path), 2)
    assert {tuple(r) for r in spark.read.parquet(target).select("doc_id", "text").collect()} == {(1, "a"), (2, "c")}


def test_availability_and_grades(spark):
    rows = [(True, "x.zip"), (False, "x.zip"), (False, "صورة"), (False, "gone"), (False, None)]
    got = [r.availability for r in reports.availability(table(spark, rows, "readable boolean, title string")).collect()]
    assert got == ["available", "archive", "image", "deleted", "deleted"]
    scores = [85.0, 80.0, 60.0, 41.0, 20.0, 3.0]
    assert [value(spark, text.grade(F.lit(s))) for s in scores] == ["excellent", "excellent", "good", "fair", "weak", "poor"]
    assert [value(spark, text.clamp(F.lit(s))) for s in (-1.0, 50.0, 101.0)] == [0.0, 50.0, 100.0]
    assert value(spark, text.thousands(F.lit(1234567))) == "1,234,567"


def test_lines_cleaned_and_flagged(spark):
    ls = lines_of(spark, "a\x07b ====== c\nx  y , z\nplain")
    cleaned, stats = lines.clean_lines(ls)
    assert [r.line for r in cleaned.orderBy("line_no").collect()] == ["ab c", "x y, z", "plain"]
    assert stats.first().asDict() == {"doc_id": 0, "controls": 1, "decoration": 1, "spaces": 2, "punctuation": 1}
    tags = [r.tags for r in lines.flag_lines(lines_of(spark, "12 - 3\nنص with Latin\na | b\nword")).orderBy("line_no").collect()]
    assert tags == [["bare"], ["mixed"], ["table"], []]
    assert [value(spark, text.without_controls(F.lit(s))) for s in ("a\x00b\x1f", "ab")] == ["ab", "ab"]


def test_headers_and_repeats(spark):
    ls = lines_of(spark, "Court Header\nbody\nCourt header", "Court Header!\nCOURT HEADER")
    _, removed = lines.repeated_headers(ls)
    assert [(r.norm, r.times, r.docs) for r in lines.header_report(removed).collect()] == [("court header", 4, 2)]
    pages = table(spark, [(1, 1, " 12 .\n"), (1, 2, "text"), (1, 3, "ab")], "doc_id long, page_no int, text string")
    assert sorted(r.page_no for r in lines.blank_pages(pages).collect()) == [1, 3]


def test_phrases_and_scraps(spark):
    phrases = {"محكمة الاستئناف": True, "محكمة": False, "محكمة 1 2 3 4 5 6 7 8 9 الحق": False, "ab cd": False, "": False, "نص ونص": True}
    assert {p: value(spark, text.plausible_phrase(F.lit(p))) for p in phrases} == phrases
    scraps = {"": True, "123": True, "اب جد": True, "محكمة الاستئناف": False, "في من الى عن المحكمة": True}
    assert {p: value(spark, text.garbled_line(F.lit(p))) for p in scraps} == scraps
    none = F.lit(None).cast("string")
    assert value(spark, text.plausible_phrase(none)) is False and value(spark, text.garbled_line(none)) is True


def test_cards_from_json(spark):
    read = lambda s: value(spark, casework.card_of_json(F.lit(s), "a long, b string, c array<int>"))
    assert tuple(read('{"a": 1, "b": "x", "c": [1, 2], "d": 0}')) == (1, "x", [1, 2])
    assert tuple(read('{"a": "no", "b": null}')) == (None, None, None)
    assert read("no json") is None and read("[1]") is None and read(None) is None


def test_small_registers(spark):
    entity = table(spark, [(1, "law", "x"), (2, "law", "x"), (1, "law", "y"), (1, "other", "z")], "doc_id long, kind string, value string")
    assert [tuple(r) for r in reports.law_register(entity, "law").collect()] == [("x", 2, 1), ("y", 1, 1)]
    annex = reports.financial_annex(table(spark, [(1,), (2,)], "doc_id long"), table(spark, [(1, "5")], "doc_id long, digits string"))
    assert {tuple(r) for r in annex.collect()} == {(1, 1), (2, 0)}
    assert [r.line for r in reports.summary_lines(lines_of(spark, "short key\na key in a longer line\nno word of it here"), "key").collect()] == ["a key in a longer line"]
    qc = table(spark, [(1, "clean", 9, 0.1), (2, "noisy", 0, 0.2), (3, "reversed", 4, 0.9), (4, "noisy", 0, 0.1)], "doc_id long, status string, reversed_lines int, word_ratio double")
    assert [r.doc_id for r in repair.worst_readability(qc).collect()] == [3, 4, 2, 1]


def test_first_best_and_joined(spark):
    df = table(spark, [("a", 2), ("a", 1), ("b", 3)], "k string, n int")
    assert {tuple(r) for r in registers.first_per_key(df, ["k"], [F.col("n")]).collect()} == {("a", 1), ("b", 3)}
    pages = table(spark, [(1, 1, "x", 1, 5.0), (1, 1, "y", 2, 9.0), (1, 1, "z", 3, 9.0), (1, 2, "x", 1, 1.0)], "doc_id long, page_no int, variant string, variant_ord int, quality double")
    assert {(r.page_no, r.variant) for r in incremental.best_variant(pages).collect()} == {(1, "y"), (2, "x")}
    wanted = table(spark, [("https://h/d/abc_1/view",), ("https://h/?id=q-2",), ("none",)], "url string")
    docs = table(spark, [("abc_1", "one"), ("q-2", "two")], "id string, title string")
    assert {(r.url[-6:], r.title) for r in pairs.join_by_file_id(wanted, docs, text.file_id(F.col("url"))).collect()} == {("1/view", "one"), ("id=q-2", "two"), ("none", None)}
    morph = table(spark, [("k1", "r"), ("k2", "r"), ("m", "s")], "term string, root string")
    assert sorted(r.term for r in search.expand_terms(table(spark, [("k1",), ("u",)], "term string"), morph).collect()) == ["k1", "k2", "u"]


def test_rank_among_equal_lines(spark):
    got = repair.same_lines(lines_of(spark, "Same line\nother\nsame LINE"))
    assert sorted((r.line_no, r.times, r.nth) for r in got.collect()) == [(1, 2, 1), (2, 1, 1), (3, 2, 2)]


def test_lines_after(spark):
    got = value(spark, extract.lines_after(F.array(*[F.lit(c) for c in "abcdef"]), F.lit(1), 3))
    assert got == ["c", "d"]
