"""Registered queries for structure and growth: streams with a watermark, folds over lines, large lexicons, groups of alike texts, versions and search indexes, each with equal SQL where SQL has the means."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text
from scriptorium.operators import casework, extract, lines, package, pairs, repair, search
from scriptorium.plans.session import shared_folder
from scriptorium.streaming import incremental, versions

HEADING = r"[A-Z0-9 ]{3,40}:?$"
QUERY = ["the", "and", "for", "with"]
ANCHORS = [("licen", "licence"), ("token", "secret"), ("https?://", "link"), ("[0-9]{6}", "number")]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def deduped_events(spark, d):
    """Events in three files by time; every fifth one comes again in the next files, in time or late. A rerun over the same checkpoint adds nothing."""
    events, path = _t(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts")), shared_folder(spark)
    span = events.select(F.unix_micros("ts").alias("t")).agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    third = max(1, -(-((span.b or 0) - (span.a or 0) + 1) // 3))
    part = F.floor((F.unix_micros("ts") - F.lit(span.a or 0)) / third)
    for k in range(3):
        again = events.where((part < k) & (F.col("event_id") % 5 == 0))
        events.where(part == k).union(again).coalesce(1).write.mode("append").parquet(f"{path}/in")
    for _ in range(2):
        incremental.dedupe_stream(spark, f"{path}/in", events.schema, f"{path}/out", f"{path}/log", "event_id", "ts", f"{max(1, third // 2_000_000)} seconds", files_a_batch=1)
    return spark.read.schema(events.schema).parquet(f"{path}/out").groupBy("event_type").agg(F.count("*").alias("rows"), F.countDistinct("event_id").alias("ids"))


def paragraphs(spark, d):
    return repair.rebuild_paragraphs(_t(spark, d, "documents"), heading=HEADING)


def captured_lines(spark, d):
    return extract.capture_after(_t(spark, d, "documents"), ANCHORS, section="[0-9]+[.)]")


def large_lexicon(spark, d):
    """Aliases from a lexicon of thousands of rows: names and numbers of orders, customers and parts."""
    rows = [
        ("order", _t(spark, d, "orders"), "o_orderpriority", "o_orderkey"), ("customer", _t(spark, d, "customer"), "c_mktsegment", "c_custkey"), ("customer", _t(spark, d, "customer"), "c_mktsegment", "c_name"),
        ("part", _t(spark, d, "part"), "p_brand", "p_partkey"), ("part", _t(spark, d, "part"), "p_brand", "p_name"),
    ]
    lexicon = reduce(DataFrame.union, [df.select(F.lit(kind).alias("kind"), F.col(label).alias("label"), F.col(key).cast("string").alias("pattern")) for kind, df, label, key in rows])
    return extract.match_aliases(_t(spark, d, "documents"), lexicon)


def near_dup_groups(spark, d):
    return pairs.near_duplicate_groups(_t(spark, d, "documents"), 0.8)


def title_groups(spark, d):
    """Titles of word triples, among which one word of three may differ."""
    parts = _t(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat_ws(" ", "p_name", "p_brand", F.col("p_size").cast("string")).alias("title"))
    return pairs.similar_title_groups(parts, 0.6)


OVERLAPS = ["the", "hese", "es an"]


def occurrences(spark, d):
    return package.highlights(_t(spark, d, "documents"), OVERLAPS)


def term_contexts(spark, d):
    docs = _t(spark, d, "documents")
    return lines.kwic(docs, OVERLAPS, 5, 8)


def versioned_texts(spark, d):
    """Texts of better candidates as a second version, by a run that is made twice; both versions read."""
    docs, path = _t(spark, d, "documents"), shared_folder(spark)
    first = docs.select("doc_id", "text", (F.col("n_chars") % 100).cast("double").alias("quality"), F.lit(False).alias("replaced"), F.lit(None).cast("string").alias("old_text"))
    better = docs.select("doc_id", F.concat(F.lit("read again: "), "text").alias("text"), (F.col("n_chars") % 83).cast("double").alias("quality"))
    versions.write_version(first, path, "first")
    for _ in range(2):
        latest = versions.update_version(spark, path, lambda rows: versions.with_best_texts(rows, better).drop("decision"), "better")
    md5 = lambda c: F.md5(F.col(c).cast("binary"))
    one = versions.read_version(spark, path, 1).select("doc_id", md5("text").alias("before"))
    two = versions.read_version(spark, path).select("doc_id", md5("text").alias("after"), md5("old_text").alias("kept"), "quality", "replaced")
    return one.join(two, "doc_id").withColumn("version", F.lit(latest))


def maintained_index(spark, d):
    """BM25 from an index to which documents were added in two batches, the second one twice; equal to one from scratch."""
    docs, path = _t(spark, d, "documents"), shared_folder(spark)
    even = F.col("lang").isin("en", "de")
    search.extend_index(docs.where(even), path, 1)
    for _ in range(2):
        search.extend_index(docs, path, 2)
    return search.search_index(spark, path, QUERY).select("doc_id", F.round("score", 6).alias("score"))


def index_terms(spark, d):
    docs, path = _t(spark, d, "documents"), shared_folder(spark)
    for k, part in enumerate((F.col("lang") == "en", F.coalesce(F.col("lang") != "en", F.lit(True)))):
        search.extend_index(docs.where(part), path, k, stem=False)
    return search.term_stats(spark, path)


def line_predicates(spark, d):
    """Phrases and scraps among the lines of each document, by Latin letters."""
    ls = lines.lines(_t(spark, d, "documents"))
    return ls.groupBy("doc_id").agg(F.count_if(text.plausible_phrase(F.col("line"), "a-z")).alias("phrases"), F.count_if(text.garbled_line(F.col("line"), "a-z")).alias("scraps"))


def json_fields(spark, d):
    """Cards as JSON and back, with one field that is missing."""
    card = casework.card_of_json(casework.card_json("doc_id", "lang", "source", "n_chars"), "doc_id long, lang string, source string, n_chars int, gone string")
    return _t(spark, d, "documents").select(card.alias("c")).select("c.*")


ARABIC = "٠١٢٣٤٥٦٧٨٩"


def arabic_timeline(spark, d):
    """Orders' dates as Hijri dates in Arabic digits, 578 years back, in both orders of day and year; with real dates."""
    date = F.col("o_orderdate").cast("date")
    parts = [F.year(date) - 578, F.month(date), F.least(F.day(date), F.lit(29))]
    shown = F.when(F.col("o_orderkey") % 2 == 0, F.concat_ws("/", *parts)).otherwise(F.concat_ws("-", *parts[::-1]))
    docs = _t(spark, d, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("doc_type"), F.col("o_custkey").cast("string").alias("path"),
        F.concat(F.lit("بتاريخ "), F.translate(shown, "0123456789", ARABIC), F.lit(" هـ")).alias("text"),
    )
    return package.unified_timeline(docs).select("calendar", "value", "date_key", "title", "doc_type", "path", F.col("date").cast("string").alias("date"), "other_key")


_STRIP = "trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_STATE = "{{'line': {}, 'form': {}, 'held': 0, 'blanks': 0, 'before': NULL::VARCHAR, 'para': 0, 'out': []::STRUCT(para INT, heading BOOLEAN, line VARCHAR)[]}}"
_FORM = f"trim(regexp_replace(lower({_STRIP}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _paragraph_sql() -> str:
    blank, two = "(x.line = '')", "(x.line = '' AND s.blanks = 1)"
    gone = "(x.line = '' OR x.form = '' OR x.form IS NOT DISTINCT FROM s.before)"
    head = f"(NOT {gone} AND regexp_matches(x.line, '^(?:{HEADING})'))"
    gathered = "(s.held + length(x.line) + CASE WHEN s.held > 0 THEN 1 ELSE 0 END)"
    full = f"(NOT {gone} AND right(x.line, 1) IN ('.', '؟', '!', '?') AND {gathered} > 40)"
    own = f"(s.para + CASE WHEN {head} AND s.held > 0 THEN 1 ELSE 0 END)"
    step = (
        f"{{'line': x.line, 'form': x.form, 'held': CAST(CASE WHEN {head} OR {full} OR {two} THEN 0 WHEN {gone} THEN s.held ELSE {gathered} END AS INT), 'blanks': CAST(CASE WHEN {blank} THEN s.blanks + 1 ELSE 0 END AS INT), "
        f"'before': CASE WHEN {gone} THEN s.before ELSE x.form END, 'para': CAST(CASE WHEN {head} THEN {own} + 1 WHEN {full} OR ({two} AND s.held > 0) THEN s.para + 1 ELSE s.para END AS INT), "
        f"'out': CASE WHEN {gone} THEN s.out ELSE list_append(s.out, {{'para': CAST({own} AS INT), 'heading': {head}, 'line': x.line}}) END}}"
    )
    states = f"list_prepend({_STATE.format('NULL::VARCHAR', 'NULL::VARCHAR')}, list_transform(string_split(text, chr(10)), lambda x: {_STATE.format(_STRIP, _FORM)}))"
    rows = f"SELECT doc_id, unnest(list_reduce({states}, lambda s, x: {step}).out) AS o, generate_subscripts(list_reduce({states}, lambda s, x: {step}).out, 1) AS i FROM documents"
    return f"SELECT doc_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY p) AS INT) AS para_no, kind, text FROM (SELECT doc_id, o.para AS p, CASE WHEN bool_or(o.heading) THEN 'heading' ELSE 'para' END AS kind, string_agg(o.line, ' ' ORDER BY i) AS text FROM ({rows}) GROUP BY doc_id, o.para)"


_ANCHOR = ", ".join(f"({k}, '{p}', '{label}')" for k, (p, label) in enumerate(ANCHORS))
ORACLE_SQL = {
    "deduped_events": "SELECT event_type, count(*) AS rows, count(DISTINCT event_id) AS ids FROM events GROUP BY event_type",
    "paragraphs": _paragraph_sql(),
    "captured_lines": f"""WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: {_STRIP}) AS ls FROM documents),
        e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM l),
        a AS (SELECT doc_id, n AS spot, k, label FROM e JOIN (VALUES {_ANCHOR}) v(k, p, label) ON regexp_matches(line, p)),
        j AS (SELECT a.doc_id, spot, k, label, n, line, length(line) AS size, length(line) > 12 AND length(line) < 500 AS good FROM a JOIN e ON e.doc_id = a.doc_id AND n > spot AND n < spot + 30),
        t AS (SELECT *, coalesce(sum(CASE WHEN good THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, spot, k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM j),
        s AS (SELECT *, max(CASE WHEN (size = 0 AND taken > 0) OR size > 600 OR taken >= 14 OR (regexp_matches(line, '^(?:[0-9]+[.)])') AND taken > 6) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, spot, k ORDER BY n) AS ended FROM t),
        c AS (SELECT doc_id, spot, k, label, n, substr(line, 1, 480) AS line, row_number() OVER (PARTITION BY doc_id, substr(regexp_replace(substr(line, 1, 480), '\\s+', ' ', 'g'), 1, 50) ORDER BY spot, k, n) AS r FROM s WHERE good AND ended = 0)
        SELECT doc_id, CAST(place AS INT) AS place, label, CAST(n AS INT) AS line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY spot, k, n) AS place FROM c WHERE r = 1) WHERE place <= 80""",
}
_REACH = "r AS (SELECT id, id AS g FROM l UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.id), c AS (SELECT id, min(g) AS g FROM r GROUP BY id)"
_PAIRS = "s AS (SELECT id, count(*) AS n FROM w GROUP BY id), m AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM w x JOIN w y ON x.w = y.w AND x.id <> y.id GROUP BY x.id, y.id), e AS (SELECT a, b FROM m JOIN s p ON p.id = a JOIN s q ON q.id = b WHERE k / (p.n + q.n - k) >= {}), l AS (SELECT DISTINCT a AS id FROM e)"
ORACLE_SQL |= {
    "large_lexicon": "WITH x AS (SELECT 'order' AS kind, o_orderpriority AS label, o_orderkey::VARCHAR AS pattern FROM orders UNION SELECT 'customer', c_mktsegment, c_custkey::VARCHAR FROM customer UNION SELECT 'customer', c_mktsegment, c_name FROM customer UNION SELECT 'part', p_brand, p_partkey::VARCHAR FROM part UNION SELECT 'part', p_brand, p_name FROM part), d AS (SELECT doc_id, text || chr(0) || reverse(text) AS t FROM documents) SELECT DISTINCT doc_id, kind, label FROM d JOIN x ON contains(t, pattern)",
    "near_dup_groups": f"""WITH RECURSIVE t AS (SELECT min(doc_id) AS id, count(*) AS n, trim(text) AS raw FROM documents GROUP BY trim(text)), v AS (SELECT id, list_filter(regexp_split_to_array(lower(raw), '\\s+'), lambda x: x <> '') AS v FROM t),
        w AS (SELECT DISTINCT id, unnest([array_to_string(v[i:i + 4], ' ') FOR i IN range(1, len(v) - 3)]) AS w FROM v WHERE len(v) >= 5), {_PAIRS.format(0.8)}, {_REACH}
        SELECT doc_id, coalesce(g, id) AS group_id FROM documents JOIN t ON trim(text) = raw LEFT JOIN c USING (id) WHERE n > 1 OR g IS NOT NULL""",
    "title_groups": f"""WITH RECURSIVE p AS (SELECT p_partkey AS doc_id, lower(concat_ws(' ', p_name, p_brand, p_size)) AS title FROM part), t AS (SELECT min(doc_id) AS id, count(*) AS n, title FROM p GROUP BY title),
        w AS (SELECT DISTINCT id, unnest(list_filter(string_split(title, ' '), lambda x: x <> '')) AS w FROM t), {_PAIRS.format(0.6)}, {_REACH}
        SELECT doc_id, coalesce(g, id) AS group_id FROM p JOIN t USING (title) LEFT JOIN c USING (id) WHERE n > 1 OR g IS NOT NULL""",
}
_TF = "SELECT doc_id, w AS term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS w FROM documents) WHERE length(w) >= 2 GROUP BY ALL"
_HITS = f"""x AS (SELECT doc_id, w, n, string_split(lower(text), w) AS p FROM documents, (VALUES {", ".join(f"('{t}', {len(t)})" for t in OVERLAPS)}) v(w, n)),
    y AS (SELECT doc_id, w, n, len(p) AS k, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM x),
    z AS (SELECT doc_id, n, i, k, CAST(sum(length(piece) + n) OVER (PARTITION BY doc_id, w ORDER BY i) AS BIGINT) AS e FROM y), h AS (SELECT doc_id, e - n AS s, e FROM z WHERE i < k),
    o AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM h),
    q AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM o), m AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM q GROUP BY doc_id, run)"""
ORACLE_SQL |= {
    "occurrences": f"WITH {_HITS} SELECT doc_id, s AS start_pos, e AS end_pos FROM m",
    "term_contexts": f"WITH {_HITS} SELECT doc_id, s AS pos, substr(text, greatest(s + 1 - 5, 1), least(5, s) + e - s + 8) AS context, count(*) OVER (PARTITION BY doc_id) AS times FROM m JOIN documents USING (doc_id)",
    "versioned_texts": "SELECT doc_id, md5(text) AS before, md5(CASE WHEN r THEN 'read again: ' || text ELSE text END) AS after, CASE WHEN r THEN md5(text) END AS kept, CASE WHEN r THEN n ELSE o END AS quality, r AS replaced, 2 AS version FROM (SELECT *, o < 60 AND n - o > 8 AS r FROM (SELECT doc_id, text, (n_chars % 100)::DOUBLE AS o, (n_chars % 83)::DOUBLE AS n FROM documents))",
    "maintained_index": f"WITH p AS ({_TF}), s AS (SELECT doc_id, sum(tf) AS len FROM p GROUP BY doc_id), t AS (SELECT count(*) AS n, avg(len) AS mean FROM s), h AS (SELECT * FROM p WHERE term IN ({', '.join(repr(q) for q in QUERY)})), df AS (SELECT term, count(*) AS df FROM h GROUP BY term) SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS score FROM h JOIN df USING (term) JOIN s USING (doc_id), t GROUP BY doc_id",
    "index_terms": f"SELECT term, count(*) AS df FROM ({_TF}) GROUP BY term",
}
_COUNT = lambda c: f"len(regexp_extract_all({c}, '[a-z]'))"
ORACLE_SQL |= {
    "line_predicates": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), p AS (SELECT doc_id, len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: {_COUNT("w")} >= 2)) >= 2 AND {_COUNT("line")} >= 0.55 * length(replace(line, ' ', '')) AS phrase,
        regexp_extract_all(line, '[a-z]+') AS runs FROM l) SELECT doc_id, count(*) FILTER (phrase) AS phrases, count(*) FILTER (len(runs) = 0 OR length(array_to_string(runs, '')) <= 4 OR len(list_filter(runs, lambda r: length(r) <= 2)) >= 0.6 * len(runs)) AS scraps FROM p GROUP BY doc_id""",
    "json_fields": "SELECT doc_id, lang, source, n_chars::INT AS n_chars, NULL::VARCHAR AS gone FROM documents",
}
_HIJRI = f"""SELECT value, title, min({{'id': doc_id, 'type': doc_type, 'path': path}}) AS f, any_value(y * 10000 + m * 100 + d) AS date_key, any_value(DATE '1970-01-01' + CAST(d + ceil(29.5 * (m - 1)) + 354 * (y - 1) + floor((3 + 11 * y) / 30.0) + 1948439 - 2440588 AS INT)) AS date
    FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN y || '/' || m || '/' || d ELSE d || '-' || m || '-' || y END AS value
    FROM (SELECT o_orderkey AS doc_id, o_orderpriority AS title, o_orderstatus AS doc_type, o_custkey::VARCHAR AS path, year(o_orderdate) - 578 AS y, month(o_orderdate) AS m, least(day(o_orderdate), 29) AS d FROM orders)) GROUP BY value, title"""
ORACLE_SQL["arabic_timeline"] = f"SELECT 'hijri' AS calendar, value, CAST(date_key AS INT) AS date_key, title, f.type AS doc_type, f.path AS path, date::DATE::VARCHAR AS date, CAST(strftime(date, '%Y%m%d') AS INT) AS other_key FROM ({_HIJRI})"
NO_SQL = ()
QUERIES = {name: globals()[name] for name in (*ORACLE_SQL, *NO_SQL)}
