"""Registered queries for operators/casework.py over the given tables, each with equal SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import casework as c
from scriptorium.operators import lines, search

WANTED, NUMBERS = ["the", "and", "der"], ["2024", "10000", "555", "987654321", "12"]
CITED = r"(?:section|version|level|no)\s*(\d{1,3})"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark, d) -> DataFrame:
    return _t(spark, d, "documents")


def missing_records(spark, d):
    texts = _docs(spark, d).select(F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit("no. ")).otherwise(F.lit("")), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "text")
    return c.index_missing(texts, _t(spark, d, "labels").select(F.col("doc_id").alias("id")))


def financial_selection(spark, d):
    docs = _docs(spark, d).select("doc_id", F.col("lang").alias("doc_type"), F.col("source").alias("title"))
    return c.financial_docs(docs, ["de", "fr"], "^[a-m]")


def flagged_docs(spark, d):
    docs = _docs(spark, d).select("doc_id", F.col("lang").alias("doc_type"), "n_chars")
    return c.filter_docs(docs, "en", _t(spark, d, "labels").where("toxic = 1"))


def reading_models(spark, d):
    return _docs(spark, d).groupBy(c.suggest_model(F.col("text"), "[0-9]{4,}", "token").alias("model")).agg(F.count("*").alias("docs"))


def cited_articles(spark, d):
    return c.extract_articles(_docs(spark, d).select("doc_id", F.lower("text").alias("text")), CITED)


def known_numbers(spark, d):
    return c.match_known_numbers(_docs(spark, d), NUMBERS)


def same_titles(spark, d):
    return c.same_title_groups(_t(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat_ws(" ", "p_name", "p_brand").alias("title")))


def study_lines_to_titles(spark, d):
    part = _t(spark, d, "part")
    lines_, titles = part.select(F.col("p_partkey").alias("line_id"), F.concat_ws(" ", "p_name", "p_type").alias("line")), part.select(F.col("p_partkey").alias("title_id"), F.concat_ws(" ", "p_type", "p_brand", "p_name").alias("title"))
    return c.match_study_lines(lines_, titles).select("line_id", "title_id", F.round("similarity", 6).alias("similarity"))


def contained_passages(spark, d):
    return c.contained_passages(_docs(spark, d), _t(spark, d, "benchmark"))


def hits_with_documents(spark, d):
    hits = c.hit_count(search.postings(_docs(spark, d)), WANTED)
    return c.hits_with_docs(hits, _docs(spark, d).select("doc_id", "lang", "source"))


def tally(spark, d):
    return c.ingest_tally(_t(spark, d, "orders").select(F.col("o_orderstatus").alias("status")))


def section_places(spark, d):
    docs = _docs(spark, d).select("doc_id", F.col("lang").alias("section"), F.col("source").alias("path"), F.col("text").alias("title"))
    return c.section_order(docs, ["doc_id", "section"])


def largest_amounts(spark, d):
    return c.top_amounts(_t(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.floor("o_totalprice").cast("long").alias("value")), 20, 5)


def documents_by_date(spark, d):
    docs = _t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("date").alias("date"))
    return c.sort_docs(docs, "date")


def most_distorted(spark, d):
    return c.worst_distortion(lines.distortion(_docs(spark, d)), 40).select("doc_id", "symbols", "repeats", "fragments", "score")


def all_known_ids(spark, d):
    return c.known_ids(_docs(spark, d).select(F.col("doc_id").alias("id")), _t(spark, d, "benchmark").select(F.col("item_id").alias("id")), _t(spark, d, "labels").select(F.col("doc_id").alias("id")))


def merged_lexicon(spark, d):
    part = _t(spark, d, "part")
    one = part.select(F.lit("type").alias("kind"), F.col("p_brand").alias("label"), F.col("p_type").alias("pattern"))
    two = part.select(F.lit("type").alias("kind"), F.lit("other").alias("label"), F.col("p_name").alias("pattern"))
    return c.merge_lexicons(one, two)


def document_list(spark, d):
    return c.list_docs(_docs(spark, d))


def denser_texts(spark, d):
    docs = _docs(spark, d).select("doc_id", "text", F.col("n_chars").cast("double").alias("density"))
    other = _docs(spark, d).select("doc_id", F.concat(F.lit("again: "), "text").alias("text"), (F.col("n_chars") * (1 + (F.col("doc_id") % 5) / 100)).alias("density"))
    return c.keep_denser(docs, other).select("doc_id", "adopted", F.md5(F.col("text").cast("binary")).alias("digest"))


def replaced_texts(spark, d):
    docs = _docs(spark, d).select("doc_id", "text", (F.col("n_chars") % 100).cast("double").alias("quality"))
    other = _docs(spark, d).select("doc_id", F.upper("text").alias("text"), (F.col("n_chars") % 83).cast("double").alias("quality"))
    return c.create_or_replace(docs, other, "replace").select("doc_id", "changed", "quality", F.length("old_text").alias("old_chars"))


def variant_comparison(spark, d):
    docs = _docs(spark, d)
    both = docs.select("doc_id", F.lit("a").alias("variant"), (F.col("n_chars") % 100).alias("quality")).union(docs.select("doc_id", F.lit("b"), F.col("n_chars") % 97))
    return c.compare_variants(both, "a", "b")


def json_cards(spark, d):
    return _docs(spark, d).select("doc_id", c.card_json("doc_id", "lang", "n_chars").alias("card"))


_TERM = "SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM documents"
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> ''))"
_FLAT = "' ' || trim(regexp_replace(lower({}), '\\s+', ' ', 'g')) || ' '"
ORACLE_SQL = {
    "missing_records": "SELECT CASE WHEN doc_id % 3 = 0 THEN 'doc_' || substr(md5('no. ' || doc_id || '.txt'), 1, 16) ELSE CAST(doc_id AS VARCHAR) END AS id, CASE WHEN doc_id % 3 = 0 THEN 'no. ' ELSE '' END || doc_id || '.txt' AS name, CASE WHEN length(trim(text)) >= 20 THEN 'ok' ELSE 'empty' END AS status FROM documents WHERE doc_id % 3 = 0 OR doc_id NOT IN (SELECT doc_id FROM labels)",
    "financial_selection": "SELECT doc_id, lang AS doc_type, source AS title FROM documents WHERE lang IN ('de', 'fr') OR regexp_matches(source, '^[a-m]')",
    "flagged_docs": "SELECT doc_id, lang AS doc_type, n_chars FROM documents WHERE lang = 'en' AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "reading_models": "SELECT CASE WHEN len(regexp_extract_all(text, '[0-9]{4,}')) >= 3 OR contains(text, 'token') THEN 'layout' ELSE 'read' END AS model, count(*) AS docs FROM documents GROUP BY 1",
    "cited_articles": "SELECT DISTINCT doc_id, CAST(n AS INT) AS article FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(lower(text), '\\s+', ' ', 'g'), '(?:section|version|level|no)\\s*(\\d{1,3})', 1)) AS n FROM documents)",
    "known_numbers": "SELECT doc_id, number FROM documents JOIN (VALUES " + ", ".join(f"('{n}')" for n in NUMBERS) + ") v(number) ON contains(text, number)",
    "same_titles": "SELECT lower(p_name || ' ' || p_brand) AS norm_title, count(*) AS docs, min(p_partkey) AS first_id FROM part GROUP BY 1 HAVING count(*) > 1",
    "study_lines_to_titles": f"WITH a AS (SELECT p_partkey AS id, {_WORDS.format('p_name || chr(32) || p_type')} AS w FROM part), b AS (SELECT p_partkey AS id, {_WORDS.format('p_type || chr(32) || p_brand || chr(32) || p_name')} AS w FROM part), m AS (SELECT a.id AS line_id, b.id AS title_id, len(list_intersect(a.w, b.w)) AS n, len(a.w) AS na, len(b.w) AS nb FROM a, b) SELECT line_id, min(title_id) AS title_id, round(arg_min(n / (na + nb - n), title_id), 6) AS similarity FROM m WHERE n / (na + nb - n) >= 0.45 GROUP BY line_id",
    "contained_passages": f"SELECT doc_id, item_id FROM (SELECT doc_id, {_FLAT.format('text')} AS t FROM documents) JOIN (SELECT item_id, {_FLAT.format('text')} AS i FROM benchmark) ON trim(i) <> '' AND contains(t, i)",
    "hits_with_documents": f"SELECT doc_id, hits, lang, source FROM (SELECT doc_id, count(*) AS hits FROM ({_TERM}) WHERE term IN ('the', 'and', 'der') GROUP BY doc_id) JOIN documents USING (doc_id)",
    "tally": "SELECT o_orderstatus AS status, count(*) AS docs FROM orders GROUP BY 1",
    "section_places": "SELECT doc_id, lang AS section, CAST(row_number() OVER (PARTITION BY lang ORDER BY source, text, doc_id) AS INT) AS place FROM documents",
    "largest_amounts": "SELECT CAST(floor(o_totalprice) AS BIGINT) AS value, count(DISTINCT o_custkey) AS docs FROM orders WHERE floor(o_totalprice) >= 10000 GROUP BY 1 ORDER BY 1 DESC LIMIT 20",
    "documents_by_date": "SELECT o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS date FROM orders ORDER BY 2, 1",
    "all_known_ids": "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents UNION SELECT CAST(item_id AS VARCHAR) FROM benchmark UNION SELECT CAST(doc_id AS VARCHAR) FROM labels",
    "merged_lexicon": "SELECT 'type' AS kind, arg_min(label, (n, label)) AS label, pattern FROM (SELECT 0 AS n, p_brand AS label, p_type AS pattern FROM part UNION ALL SELECT 1, 'other', p_name FROM part) GROUP BY pattern",
    "document_list": "SELECT * EXCLUDE (text) FROM documents",
    "denser_texts": "SELECT doc_id, a AS adopted, md5(CASE WHEN a THEN 'again: ' || text ELSE text END) AS digest FROM (SELECT doc_id, text, n_chars * (1 + (doc_id % 5)::DOUBLE / 100) >= n_chars * 1.02::DOUBLE AND length(trim('again: ' || text)) > 50 AS a FROM documents)",
    "replaced_texts": "SELECT doc_id, n > o + 8 AS changed, CASE WHEN n > o + 8 THEN n ELSE o END AS quality, CASE WHEN n > o + 8 THEN length(text) END AS old_chars FROM (SELECT doc_id, text, CAST(n_chars % 100 AS DOUBLE) AS o, CAST(n_chars % 83 AS DOUBLE) AS n FROM documents)",
    "variant_comparison": "SELECT doc_id, a, b, b - a AS difference, CASE WHEN b - a > 2 THEN 'b' WHEN a - b > 2 THEN 'a' END AS winner FROM (SELECT doc_id, n_chars % 100 AS a, n_chars % 97 AS b FROM documents)",
    "json_cards": """SELECT doc_id, '{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || '}' AS card FROM documents""",
    "most_distorted": "SELECT doc_id, symbols, repeats, fragments, round((3 * symbols + repeats + fragments) / greatest(1.0, length(text) / 500.0), 4) AS score FROM (SELECT doc_id, text, len(regexp_extract_all(text, '[�■□¤]')) AS symbols, len(list_filter(c, lambda x, i: i >= 4 AND x = c[i - 1] AND x = c[i - 2] AND x = c[i - 3] AND (i = 4 OR x <> c[i - 4]) AND x NOT IN (' ', chr(9), chr(10), chr(11), chr(12), chr(13)))) AS repeats, len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) BETWEEN 1 AND 2)) AS fragments FROM (SELECT doc_id, text, string_split(text, '') AS c FROM documents)) ORDER BY score DESC, doc_id LIMIT 40",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
