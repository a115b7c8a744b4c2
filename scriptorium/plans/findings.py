"""Registered queries over findings, search tables and ingested documents, each with equal SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import extract, lines, registers, reports, search
from scriptorium.plans.session import shared_folder
from scriptorium.streaming import incremental

#: Patterns for the texts of the given tables, in the way of the defaults of each operator.
MONEY, CUE = r"([0-9][0-9.,]{2,})\s*(?:f|ares|e|b|USD|EUR|GB)", r"(?:[Vv]ersion|NC|card|call|no)\s*([0-9][0-9.,]{2,})"
MAIL, SHOUT, MONTH, SUM = "[a-z0-9._]+@[a-z0-9.]+", "[A-Z]{4,}", "[0-9]{4}-[0-9]{2}", r"[0-9]+\.[0-9]+"
ALIASES = [("word", "article", "the"), ("word", "backward", "eht"), ("sign", "at", "@"), ("sign", "at", "http")]
RULES = [("notice", "licen", 0), ("secret", "token", 1), ("report", " the ", 2), ("bericht", " der ", 3)]
NATURES = {"en": "ruling", "de": "document"}
LATE = ["der", "les"]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _all(pattern: str):
    return F.regexp_extract_all("text", F.lit(pattern), F.lit(0))


def _found(spark, d) -> DataFrame:
    text = F.col("text")
    return _docs(spark, d).select(
        "doc_id", F.col("lang").alias("doc_type"), "text", extract.long_numbers(text, 9).alias("deeds"), extract.long_numbers(text, 6).alias("cases"), _all(SUM).alias("amounts"),
        F.array_sort(F.array_distinct(_all(MAIL))).alias("parties"), F.array_sort(F.array_distinct(_all(SHOUT))).alias("courts"), _all(MONTH).alias("dates"),
    )


def amounts_by_cue(spark, d):
    out = extract.extract_amounts(_docs(spark, d), MONEY, CUE)
    return out.select("doc_id", "amount_key", F.col("amount_value").cast("double").alias("amount_value"), F.col("scaled_value").cast("double").alias("scaled_value"), "shown")


def found_aliases(spark, d):
    return extract.match_aliases(_docs(spark, d), spark.createDataFrame(ALIASES, "kind string, label string, pattern string"))


def new_findings(spark, d):
    return reports.new_findings(_found(spark, d), NATURES)


def summaries(spark, d):
    return reports.summarize(_found(spark, d))


def cited_sources(spark, d):
    docs = _docs(spark, d)
    out = reports.law_references(extract.entities(docs, "mail", _all(MAIL)), docs.select("doc_id", F.col("source").alias("title")), ["mail"])
    return out.select("kind", "value", "sources", F.array_join("samples", ",").alias("samples"))


def cleaning_report(spark, d):
    docs = _docs(spark, d).select("doc_id", "text")
    after = docs.withColumn("text", F.regexp_replace("text", r"\b[0-9]+\b", ""))
    return reports.cleaning_metrics(docs, after, mixed="[a-z][0-9]|[0-9][a-z]", review=spark.read.parquet(f"{d}/labels.parquet").where("toxic = 1"))


def keyword_contexts(spark, d):
    return lines.kwic(_docs(spark, d), ["license", "token"])


def master_rows(spark, d):
    docs = _docs(spark, d).select(
        F.col("doc_id").alias("id"), F.col("text").alias("title"), F.col("lang").alias("doc_type"), F.col("source").alias("parent_path"), F.lit("1999-01-02T03:04").alias("modifiedTime"), F.lit("txt").alias("fileExtension"),
        F.octet_length("text").alias("fileSize"), (F.col("n_chars") >= 100).alias("readable"), F.lit("ok").alias("availability"), F.lit("").alias("viewUrl"), "text", (F.col("doc_id") % 2 == 0).alias("repaired"),
    )
    return reports.master_table(docs, f"({MONTH})").drop("title")


def ranked_prefixes(spark, d):
    return search.ranked_search(_docs(spark, d), "th an x")


def written_index(spark, d):
    """Texts and postings written as a search table, and ranks read from it."""
    path = shared_folder(spark)
    search.build_search_table(_docs(spark, d).select("doc_id", "text"), path)
    docs, index = search.search_table(spark, path)
    ranked = search.bm25(index, LATE, sizes=docs.select("doc_id", "length")).select("doc_id", F.round("score", 6).alias("score"))
    return registers.top(ranked, 400, F.desc("score"), F.col("doc_id"))


def ingested_documents(spark, d):
    """All documents through the stream that classifies, extracts, makes cards and measures quality; a second run with a new checkpoint adds nothing."""
    path, rules = shared_folder(spark), spark.createDataFrame(RULES, "label string, pattern string, ord int")
    title = lambda b: b.withColumn("title", F.col("source"))
    for run in ("first", "second"):
        incremental.ingest_documents(spark, f"{d}/documents.parquet*", _docs(spark, d).schema, f"{path}/records", f"{path}/{run}", rules, ["license", "token"], {"number": "([0-9]{6,})"}, "A-Za-z", title)
    card = lambda k: F.coalesce(F.col("card")[k], F.lit("")).alias(k)
    return spark.read.parquet(f"{path}/records").select("doc_id", "doc_type", card("authority"), card("number"), F.array_join("numbers", ",").alias("numbers"), "readable", "quality")


_TOKEN = "regexp_extract_all(text, '[\\p{L}\\p{N}_]+')"
_LONG = lambda n: f"list_sort(list_distinct(list_filter({_TOKEN}, lambda x: regexp_full_match(x, '[0-9]{{{n},}}'))))"
_PART = lambda label, c: f"CASE WHEN len({c}) > 0 THEN '{label}: ' || array_to_string({c}, ', ') END"
_ITEMS = f"SELECT doc_id, lang, text, {_LONG(9)} AS deeds, {_LONG(6)} AS cases, regexp_extract_all(text, '{SUM}') AS amounts, list_sort(list_distinct(regexp_extract_all(text, '{MAIL}'))) AS parties, list_sort(list_distinct(regexp_extract_all(text, '{SHOUT}'))) AS courts, regexp_extract_all(text, '{MONTH}') AS dates FROM documents"
_SMALL = "list_filter(amounts, lambda a: length(regexp_replace(a, '[^0-9]', '', 'g')) <= 10)"
_OPENING = "substr(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '^\\[.*?\\]\\s*', ''), 1, 300)"
_W = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 2)"
_N = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> ''))"
_CUT = "regexp_replace(text, '\\b[0-9]+\\b', '', 'g')"
_KEPT = "list_filter(string_split({}, chr(10)), lambda x: trim(x) <> '')"
_BM = lambda n, df: f"ln(1 + (docs - {df} + 0.5) / ({df} + 0.5)) * {n} * 2.5 / ({n} + 1.5 * (0.25 + 0.75 * n / mean))"
_STRIP = "trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
#: Counts of quality_metrics with Latin letters as the script and digits as the other one.
QUALITY = f"""WITH t AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP}), lambda x: x <> '') AS ls FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
n AS (SELECT doc_id, length(text) AS chars, {_N.format('text')} AS words, len(ls) AS k, len(regexp_extract_all(text, '[A-Za-z]')) AS script_letters, len(regexp_extract_all(text, '\\p{{L}}')) AS letters, len(regexp_extract_all(text, '[�□¿⸻]')) AS bad_symbols,
len(regexp_extract_all(text, '[A-Za-z][OTHER]|[OTHER][A-Za-z]')) AS mixed, len(list_filter(ls, lambda x: length(x) <= 2)) AS short_lines, len(list_filter(ls, lambda x: regexp_full_match(x, '[0-9٠-٩\\s.\\-_،|]+'))) AS number_lines FROM t),
r AS (SELECT *, letters - script_letters AS other_letters, script_letters / greatest(letters, 1) AS script_ratio, 1 - short_lines / greatest(k, 1) AS line_ratio, bad_symbols / greatest(chars, 1) AS bad, short_lines / greatest(k, 1) AS fragments FROM n),
q AS (SELECT *, greatest(0.0, least(100.0, 100 * (0.55::DOUBLE * script_ratio + 0.30::DOUBLE * line_ratio - 20 * bad - 0.15::DOUBLE * fragments))) AS q FROM r)
SELECT doc_id, chars, words, script_letters, bad_symbols, mixed, short_lines, number_lines, other_letters, round(script_ratio, 6) AS script_ratio, round(line_ratio, 6) AS line_ratio, round(bad, 6) AS bad, round(fragments, 6) AS fragments, round(q, 1) AS quality, round(100 - q, 1) AS risk FROM q"""

ORACLE_SQL = {
    "amounts_by_cue": f"WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents), r AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(t, '{MONEY}', 1), regexp_extract_all(t, '{CUE}', 1))) AS raw FROM t), k AS (SELECT doc_id, regexp_replace(raw, '[^0-9]', '', 'g') AS amount_key, try_cast(replace(rtrim(raw, '.,'), ',', '') AS DECIMAL(20, 2)) AS v FROM r) SELECT doc_id, amount_key, CAST(max(v) AS DOUBLE) AS amount_value, CAST(max(v) AS DOUBLE) AS scaled_value, format('{{:,}}', CAST(amount_key AS BIGINT)) AS shown FROM k WHERE length(amount_key) BETWEEN 4 AND 13 GROUP BY doc_id, amount_key",
    "found_aliases": "SELECT DISTINCT doc_id, kind, label FROM documents JOIN (VALUES " + ", ".join(f"('{k}', '{n}', '{p}')" for k, n, p in ALIASES) + ") l(kind, label, pattern) ON contains(text, pattern) OR contains(text, reverse(pattern))",
    "new_findings": f"SELECT * FROM (SELECT doc_id, CASE lang WHEN 'en' THEN 'ruling' WHEN 'de' THEN 'document' ELSE 'fact' END AS nature, concat_ws(' | ', {_PART('deeds', 'deeds')}, {_PART('amounts', 'amounts[1:3]')}, {_PART('cases', 'cases')}) AS found FROM ({_ITEMS})) WHERE found <> ''",
    "summaries": f"SELECT doc_id, concat_ws(' | ', 'type: ' || lang, {_PART('parties', 'parties')}, {_PART('courts', 'courts[1:3]')}, {_PART('cases', 'cases')}, {_PART('deeds', 'deeds')}, {_PART('amounts', _SMALL + '[1:4]')}, {_PART('dates', 'dates[1:4]')}, CASE WHEN {_OPENING} <> '' THEN 'opening: ' || {_OPENING} END) AS summary FROM ({_ITEMS})",
    "cited_sources": f"SELECT 'mail' AS kind, value, count(DISTINCT source) AS sources, array_to_string(list_sort(list(DISTINCT source))[1:5], ',') AS samples FROM (SELECT source, unnest(regexp_extract_all(text, '{MAIL}')) AS value FROM documents) GROUP BY value",
    "cleaning_report": f"SELECT count(*) AS docs, CAST(sum(pb) AS BIGINT) AS paragraphs_before, CAST(sum(pa) AS BIGINT) AS paragraphs_after, CAST(sum(wb) AS BIGINT) AS words_before, CAST(sum(wa) AS BIGINT) AS words_after, CAST(sum(mx) AS BIGINT) AS mixed_lines, CAST(sum(tb) AS BIGINT) AS table_lines, count(*) FILTER (abs(wa - wb) * 100 > greatest(wb, 1) * 8 OR doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS review_docs, CAST(0 AS BIGINT) AS reversed_docs, round(100 * (sum(wa) - sum(wb)) / sum(wb), 4) AS change FROM (SELECT doc_id, len({_KEPT.format('text')}) AS pb, len({_KEPT.format(_CUT)}) AS pa, {_N.format('text')} AS wb, {_N.format(_CUT)} AS wa, len(list_filter({_KEPT.format('text')}, lambda x: regexp_matches(x, '[a-z][0-9]|[0-9][a-z]'))) AS mx, len(list_filter({_KEPT.format('text')}, lambda x: regexp_matches(x, '\\||\\t|( {{3,}}\\S+){{2}}'))) AS tb FROM documents)",
    "keyword_contexts": "SELECT doc_id, s AS pos, substr(text, greatest(s - 31, 1), least(32, s) + n + 40) AS context, count(*) OVER (PARTITION BY doc_id) AS times FROM (SELECT doc_id, text, n, e - n AS s FROM (" + " UNION ALL ".join(f"SELECT doc_id, text, {len(t)} AS n, i, k, CAST(sum(length(piece) + {len(t)}) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e FROM (SELECT doc_id, text, unnest(p) AS piece, generate_subscripts(p, 1) AS i, len(p) AS k FROM (SELECT doc_id, text, string_split(lower(text), '{t}') AS p FROM documents))" for t in ("license", "token")) + ") WHERE i < k)",
    "master_rows": f"SELECT doc_id AS id, lang AS doc_type, source AS parent_path, coalesce(nullif(regexp_extract(text, '({MONTH})', 1), ''), '1999-01-02') AS date, 'txt' AS fileExtension, strlen(text) AS fileSize, n_chars >= 100 AS readable, 'ok' AS availability, '' AS viewUrl, CASE WHEN doc_id % 2 = 0 THEN 'repaired' WHEN length(text) > 0 THEN 'logical' ELSE 'none' END AS text_source, length(text) AS n_chars, '' AS summary FROM documents",
    "ranked_prefixes": f"WITH c AS (SELECT doc_id, w, len(w) AS n, len(list_filter(w, lambda x: starts_with(x, 'th'))) AS a, len(list_filter(w, lambda x: starts_with(x, 'an'))) AS b FROM (SELECT doc_id, {_W} AS w FROM documents)), s AS (SELECT count(*) FILTER (n > 0) AS docs, avg(n) FILTER (n > 0) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c) SELECT doc_id, round({_BM('a', 'da')} + {_BM('b', 'db')}, 6) AS score, array_to_string(w[p:p + 13], ' ') AS snippet FROM (SELECT *, greatest(list_position(list_transform(w, lambda x: starts_with(x, 'th') OR starts_with(x, 'an')), true) - 7, 1) AS p FROM c WHERE a > 0 AND b > 0), s ORDER BY score DESC, doc_id LIMIT 400",
    "written_index": f"WITH c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'der')) AS a, len(list_filter(w, lambda x: x = 'les')) AS b FROM (SELECT doc_id, {_W} AS w FROM documents)), s AS (SELECT count(*) FILTER (n > 0) AS docs, avg(n) FILTER (n > 0) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c) SELECT doc_id, round({_BM('a', 'da')} + {_BM('b', 'db')}, 6) AS score FROM c, s WHERE a + b > 0 ORDER BY score DESC, doc_id LIMIT 400",
    "ingested_documents": f"SELECT doc_id, CASE {' '.join(f'WHEN contains(lower({c}), {p!r}) THEN {n!r}' for c in ('source', 'text') for n, p, _ in RULES)} ELSE 'unclassified' END AS doc_type, CASE WHEN contains(head, 'license') THEN 'license' WHEN contains(head, 'token') THEN 'token' WHEN contains(text, 'license') THEN 'license' WHEN contains(text, 'token') THEN 'token' ELSE '' END AS authority, regexp_extract(head, '([0-9]{{6,}})', 1) AS number, array_to_string({_LONG(6)}, ',') AS numbers, {_STRIP.replace('(x', '(text')} <> '' AS readable, quality FROM (SELECT *, left(array_to_string(string_split(text, chr(10))[1:18], chr(10)), 1000) AS head FROM documents) JOIN ({QUALITY.replace('[OTHER]', '[A-Za-z]')}) USING (doc_id)",
}
QUALITY = QUALITY.replace("[OTHER]", "[0-9]")
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
