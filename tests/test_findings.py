"""Rules that the SQL of findings.py does not reach: Arabic forms, magnitudes, empty inputs, null keys, fallbacks."""

from decimal import Decimal

from pyspark.sql import functions as F

from scriptorium.operators import extract, lines, reports, search
from scriptorium.sources import files
from scriptorium.streaming import incremental


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


def test_amounts_with_cue_and_magnitude(spark):
    got = extract.extract_amounts(docs(spark, "بقيمة 500 ألف ريال", "مبلغ 300 فقط", "قدره 1.5 مليون", "مبلغ 12345678901234 ريال", None, "")).collect()
    assert {(r.doc_id, r.amount_key, r.amount_value, r.scaled_value, r.shown) for r in got} == {(1, "500", Decimal("500.00"), Decimal("500000.00"), "500"), (3, "15", Decimal("1.50"), Decimal("1500000.00"), "15")}


def test_rules_as_constants_equal_rules_as_a_table(spark, monkeypatch):
    d = docs(spark, "ab محكمة", "ba x", None, "").withColumn("title", F.lit("t"))
    rules = spark.createDataFrame([("one", "ab", 1), ("two", "x", 0), ("one", None, 2), ("one", "a", 3)], "label string, pattern string, ord int")
    lexicon = rules.withColumn("kind", F.lit("k"))
    run = lambda: [sorted(map(tuple, f.collect()), key=str) for f in (extract.classify_type(d, rules, ["a"]), extract.classify_segments(d, rules), extract.match_aliases(d, lexicon))]
    short = run()
    monkeypatch.setattr(extract, "RULE_ROWS", 0)
    assert short == run() and short[0][0] == (1, "one")
    none = rules.limit(0)
    monkeypatch.undo()
    assert {r.doc_type for r in extract.classify_type(d, none).collect()} == {"unclassified"} and extract.classify_segments(d, none).count() == 0


def test_quality_counts(spark):
    q = lines.quality_metrics(docs(spark, "الحكم abc\n\t12 \n\nنصa", None)).orderBy("doc_id").collect()
    assert (q[0].words, q[0].script_letters, q[0].other_letters, q[0].short_lines, q[0].number_lines, q[0].mixed) == (4, 7, 4, 1, 1, 1)
    assert (q[1].chars, q[1].words, q[1].quality) == (0, 0, 30.0)
    assert lines.distortion(docs(spark, "aaaa □\n" + "x\n" * 6)).first().issues == ["symbols", "repeats", "fragments"]
    form = lines.quality_metrics(docs(spark, "ﺏ"), compatibility=True).first()
    assert form.script_letters == 1


def test_contexts_of_literal_terms(spark):
    got = lines.kwic(docs(spark, "a.b axb A.B", None, ""), ["a.b"], 2, 2).orderBy("pos").collect()
    assert [(r.pos, r.context, r.times) for r in got] == [(0, "a.b a", 2), (8, "b A.B", 2)]


def test_summary_parts(spark):
    kind = "doc_id long, doc_type string, text string, parties array<string>, courts array<string>, cases array<string>, deeds array<string>, amounts array<string>, dates array<string>"
    rows = [(1, "ruling", "[page 1]  a \n b", ["p"], ["a", "b", "c", "d"], [], [], ["12,345,678,901", "5"], []), (2, None, None, [], [], [], [], [], [])]
    got = {r.doc_id: r.summary for r in reports.summarize(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: "type: ruling | parties: p | courts: a, b, c | amounts: 5 | opening: a b", 2: "type: unclassified"}


def test_cleaning_metrics_of_nothing_and_reversed(spark):
    none = docs(spark, "x").limit(0)
    assert reports.cleaning_metrics(none, none).first()[:3] == (0, 0, 0)
    one = docs(spark, "a b\n\nنص abc | x", None)
    r = reports.cleaning_metrics(one, docs(spark, "a b", None), reversed_docs=one.select("doc_id").limit(1)).first()
    assert (r.docs, r.paragraphs_before, r.paragraphs_after, r.mixed_lines, r.table_lines, r.review_docs, r.reversed_docs) == (2, 2, 1, 1, 1, 1, 1)


def test_ranked_search_falls_back_to_the_whole_query(spark):
    d = docs(spark, "alpha beta", "alphabet soup", "x-y z", None, "")
    assert [r.doc_id for r in search.ranked_search(d, "alph bet").collect()] == [1]
    assert [(r.doc_id, r.score) for r in search.ranked_search(d, "lphabet so").collect()] == [(2, 0.0)]
    assert search.ranked_search(d, "x").count() == 0 and search.ranked_search(d.limit(0), "alph").count() == 0


def test_both_ways_to_rank_agree(spark, tmp_path):
    d = docs(spark, "والكتاب كتاب law", "law law كتابها", "other", None)
    search.build_search_table(d, str(tmp_path))
    kept, index = search.search_table(spark, str(tmp_path))
    direct = {r.doc_id: round(r.score, 9) for r in search.bm25_texts(d, ["كتاب", "law"]).collect()}
    written = {r.doc_id: round(r.score, 9) for r in search.bm25(index, ["كتاب", "law"], sizes=kept.select("doc_id", "length")).collect()}
    assert direct == written and set(direct) == {1, 2}


def test_null_keys_arrive_once(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = spark.createDataFrame([(None, "a"), (None, "b"), (2**53 + 1, "c")], "id long, v string")
    rows.coalesce(1).write.parquet(src)
    for run in ("one", "two"):
        incremental.ingest_stream(spark, src, rows.schema, out, f"{tmp_path}/{run}")
    assert sorted((r.id for r in spark.read.parquet(out).collect()), key=str) == [2**53 + 1, None]


def test_documents_and_audit_files(spark, tmp_path):
    d = docs(spark, "نص", None)
    files.write_documents(d, f"{tmp_path}/d", "json")
    assert sorted(map(tuple, files.read_documents(spark, f"{tmp_path}/d", "doc_id long, text string").collect())) == [(1, "نص"), (2, None)]
    files.write_audit_json(d, f"{tmp_path}/a", {"counts": d.groupBy().count()}, case="x")
    assert spark.read.json(f"{tmp_path}/a/counts").first()["count"] == 2 and spark.read.json(f"{tmp_path}/a/meta").first()["case"] == "x"
