"""The registered queries of the audit library over the given tables, each with equal SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import file_id
from scriptorium.operators import extract, lines, package, pairs, registers, repair, reports, search
from scriptorium.plans import casework, findings, structure
from scriptorium.plans.session import shared_folder
from scriptorium.streaming import incremental

#: (label, pattern, ord)
TYPE_RULES = [("notice", "licen", 0), ("secret", "token", 1), ("report", " the ", 2), ("bericht", " der ", 3), ("rapport", " les ", 4), ("informe", " los ", 5)]
SEGMENTS = [("legal", "licen", 0), ("legal", "copyright", 1), ("contact", "@", 2), ("contact", "http", 3), ("secret", "token", 4), ("secret", "password", 5)]
QUERY = ["the", "and", "for", "with"]
TERMS = ["the", "der", "les", "los", "and"]
SECTIONS = [("legal", ["licen", "copyright"], 1), ("contact", ["@", "http", "www"], 1), ("list", [",", ";"], 2)]
CATEGORIES = [("notice", "legal"), ("secret", "legal"), ("report", "texts"), ("bericht", "texts")]
CONCEPTS = [("the", "article", "grammar"), ("der", "article", "grammar"), ("and", "conjunction", "grammar"), ("token", "secret", "security"), ("password", "secret", "security")]
NUMBERS = ["2024", "10000", "555", "987654321"]
UNITS, MONEY = "USD|EUR|GB|MB", "price|total|amount|license|card|the|der"
MAIL = "[a-z0-9._]+@[a-z0-9.]+"
SPANS = {"mail": "[a-z0-9._]+@[a-z0-9.]+", "number": "[0-9]{4,}"}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rules(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(rows, "label string, pattern string, ord int")


def _values(rows) -> str:
    return "(VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in rows) + ") r(label, pattern, ord)"


def line_table_stats(spark, d):
    ls = lines.lines(_t(spark, d, "documents"))
    return ls.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max(F.length("line")).alias("longest"), F.count_if(F.length("line") == 0).alias("blank"), F.count_if(F.col("line").rlike(r"^[0-9 .,-]+$")).alias("bare"))


def header_repeats(spark, d):
    _, removed = lines.repeated_headers(lines.lines(_t(spark, d, "documents")))
    return removed.groupBy("doc_id", "norm").agg(F.count("*").alias("times"), F.min(F.when(F.col("identity"), F.col("line_no"))).alias("first_line"))


def boilerplate_lines(spark, d):
    return lines.boilerplate(lines.lines(_t(spark, d, "documents")), least_docs=3, share=0.002)


def distortion_scores(spark, d):
    out = lines.distortion(_t(spark, d, "documents"), "[*%&$#]")
    return out.select("doc_id", "symbols", "repeats", "fragments", "score", F.array_join("issues", ",").alias("issues"))


def quality_metrics(spark, d):
    q = lines.quality_metrics(_t(spark, d, "documents"), script="A-Za-z", other="0-9")
    return q.withColumns({c: F.round(c, 6) for c in ("script_ratio", "line_ratio", "bad", "fragments")})


def doc_type_rules(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.col("source").alias("title"), "text")
    return extract.classify_type(docs, _rules(spark, TYPE_RULES))


def segment_rules(spark, d):
    out = extract.classify_segments(_t(spark, d, "documents"), _rules(spark, SEGMENTS))
    return out.select("doc_id", "label", F.array_join("keywords", ",").alias("keywords"))


def long_numbers(spark, d):
    return extract.entities(_t(spark, d, "documents"), "number", extract.long_numbers(F.col("text")))


def number_df(spark, d):
    return extract.entity_frequency(long_numbers(spark, d), 50)


def qc_join_distribution(spark, d):
    docs = pairs.join_qc(_t(spark, d, "documents"), _t(spark, d, "labels").select("doc_id", "quality", "toxic"))
    return registers.distribution(docs, ["lang", "quality", "toxic"])


def exact_dups(spark, d):
    return pairs.exact_duplicates(_t(spark, d, "documents"))


def same_size_groups(spark, d):
    return pairs.same_size_groups(_t(spark, d, "documents"), "n_chars")


def similar_titles(spark, d):
    parts = _t(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("title"))
    return pairs.similar_titles(parts, 0.8).select("a", "b", F.round("similarity", 6).alias("similarity"))


def near_dups(spark, d):
    return pairs.near_duplicates(_t(spark, d, "documents"), 0.8).select("a", "b", F.round("similarity", 6).alias("similarity"))


def study_reconcile(spark, d):
    study = _t(spark, d, "benchmark").select(F.col("item_id").alias("id"))
    return pairs.reconcile(study, _t(spark, d, "labels").select(F.col("doc_id").alias("id")), "id")


def page_ranges(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", lines.page_estimate(F.col("text")).alias("n_pages"))
    return registers.page_ranges(docs, "doc_id", F.col("n_pages")).select("doc_id", "page_from", "page_to")


def doc_numbering(spark, d):
    return registers.number_rows(_t(spark, d, "documents").select("doc_id"), "doc_id", "DOC-")


def run_grouping(spark, d):
    """Runs of turns of like length."""
    sized = _t(spark, d, "conversations").withColumn("size", F.when(F.length("text") >= 100, "long").otherwise("short"))
    turns = lines.run_groups(sized, ["conv_id"], ["turn"], "size")
    return turns.groupBy("conv_id", "run_no", "size").agg(F.count("*").alias("turns"), F.min("turn").alias("first_turn"))


def central_documents(spark, d):
    text = F.col("text")
    docs = _t(spark, d, "documents").withColumn("_numbers", extract.long_numbers(text)).select(
        "doc_id", F.when(F.contains(F.lower(text), F.lit("licen")), "notice").otherwise("text").alias("doc_type"), F.size(F.filter("_numbers", lambda n: F.length(n) >= 9)).alias("n_deeds"), F.size("_numbers").alias("n_cases"),
        F.regexp_count(text, F.lit(r"[0-9]+\.[0-9]")).alias("n_amounts"), F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(MAIL), F.lit(0)))).alias("n_parties"), (F.col("n_chars") >= 1000).alias("readable"),
    )
    scored = extract.importance(docs, ["notice"]).select("doc_id", F.col("importance").cast("long").alias("importance"))
    return registers.top(scored.where("importance >= 3"), 25, F.desc("importance"), F.col("doc_id"))


def bm25_topk(spark, d):
    ranked = search.bm25_texts(_t(spark, d, "documents"), QUERY).select("doc_id", F.round("score", 6).alias("score"))
    return registers.top(ranked, 400, F.desc("score"), F.col("doc_id"))


def boolean_search(spark, d):
    return search.boolean_search(_t(spark, d, "documents"), terms=["license", "token"], nots=["the"], mode="or").select("doc_id")


def word_families(spark, d):
    return search.word_families(_t(spark, d, "documents")).where("docs >= 2").select("stem", "times", "docs", F.array_join("forms", ",").alias("forms"))


def url_ids(spark, d):
    pages = _t(spark, d, "pages").select("page_id", F.regexp_extract("url", "/[a-z]{2}/([0-9]+)", 1).alias("file_id"), F.coalesce(file_id(F.replace("url", F.lit("/en/"), F.lit("/d/"))), F.lit("")).alias("drive_id"))
    return pages


def parts_packing(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"))
    return registers.pack_parts(docs, "doc_id", F.col("size"), 200_000).groupBy("part").agg(F.count("*").alias("docs"), F.sum("size").alias("bytes"))


def keep_best(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", (F.col("n_chars") % 100).cast("double").alias("quality"), F.lit(False).alias("replaced"))
    better = _t(spark, d, "labels").select("doc_id", (F.col("quality") * 40 + F.col("doc_id") % 40).cast("double").alias("quality"))
    return incremental.outcome_counts(incremental.keep_best(docs, better))


def ingest_batches(spark, d):
    """Events as files of two halves of their time range, through the stream one after the other; a third run over all files with a new checkpoint adds nothing."""
    events, path = _t(spark, d, "events").select("event_id", "event_type", "ts"), shared_folder(spark)
    span = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    early = F.coalesce(F.col("ts") < F.lit(span.a + (span.b - span.a) / 2), F.lit(False)) if span.a is not None else F.lit(True)
    for part, run in ((events.where(early), "stream"), (events.where(~early), "stream"), (events.limit(0), "again")):
        part.write.mode("append").parquet(f"{path}/in")
        incremental.ingest_stream(spark, f"{path}/in", events.schema, f"{path}/out", f"{path}/{run}", "event_id")
    return spark.read.parquet(f"{path}/out").groupBy("event_type").agg(F.count("*").alias("rows"), F.countDistinct("event_id").alias("ids"))


def doubling_collapse(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(repair.collapse_doubling(F.col("text"), "A-Za-z")).alias("digest"))


def learned_terms(spark, d):
    return repair.learn_terms(_t(spark, d, "documents"), ["the ([a-z]+ [a-z]+)", "and ([a-z]+ [a-z]+)"], ["of", "to"])


def lexical_density(spark, d):
    return repair.lexical_density(_t(spark, d, "documents"), TERMS)


def readability_qc(spark, d):
    """Latin runs keep their order when a line is turned around, so single words can't tell directions here: no line counts as reversed."""
    return repair.readability_qc(lines.lines(_t(spark, d, "documents")), TERMS, script="A-Za-z").select("doc_id", "reversed_lines", "word_ratio", "words", "status")


def section_runs(spark, d):
    return repair.section_lines(lines.lines(_t(spark, d, "documents")), SECTIONS)


def cleaning_drift(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text")
    return repair.cleaning_drift(docs, docs.withColumn("text", F.regexp_replace("text", r"\b[0-9]+\b", "")))


def header_zones(spark, d):
    zones = repair.header_zones(lines.lines(_t(spark, d, "documents")), body="^(The|Der|Les|Los) ", strong="^[A-Z ]+$")
    return zones.groupBy("doc_id", "zone").agg(F.count("*").alias("n_lines"), F.min("line_no").alias("first_line"))


def card_fields(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.col("source").alias("title"), "text")
    cards = reports.build_cards(docs, ["license", "token", "the "], {"title:number": "([0-9]{4,})", "number": "([0-9]{6,})", "any:number": "([0-9]{5,})", "mail": "([a-z0-9._]+@[a-z0-9.]+)"})
    return cards.select("doc_id", *[F.coalesce(F.col("card")[k], F.lit("")).alias(k) for k in ("authority", "number", "mail")])


def financial_figures(spark, d):
    return reports.financial_figures(lines.lines(_t(spark, d, "documents")), UNITS, MONEY).select("doc_id", "line_no", "digits", "unit")


def study_sections(spark, d):
    turns = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), (F.col("role") == "user").alias("is_heading"), "text", F.when(F.col("role") != "user", F.length("text")).alias("file_id"))
    return reports.assign_sections(turns).select("file_id", "doc_id", "pos", F.md5("section").alias("section"))


def study_records(spark, d):
    links = _t(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("file_id"), F.col("text").alias("row_desc"), F.lit("link").alias("anchor"))
    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_id"), "source", "text")
    meta = docs.select("file_id", F.when(F.col("file_id").cast("long") % 2 == 0, F.col("source")).alias("title"))
    return reports.study_index(links, meta, docs, ["link", "web"]).select("file_id", "title", "text_status")


def deed_register(spark, d):
    deeds = spark.createDataFrame([(n,) for n in NUMBERS], "number string")
    return reports.deed_register(deeds, _t(spark, d, "documents").select("doc_id", F.col("source").alias("title"), "text"))


def tag_spans(spark, d):
    return reports.tag_spans(_t(spark, d, "documents"), SPANS)


def central_values(spark, d):
    out = reports.central_values(long_numbers(spark, d), _t(spark, d, "documents").select("doc_id", F.col("source").alias("title")))
    return out.select("value", "times", "docs", F.array_join("samples", ",").alias("samples"))


def corpus_counts(spark, d):
    docs = _t(spark, d, "documents").join(_t(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", "left")
    return reports.corpus_counts(docs.select((F.col("quality") == 0).alias("is_folder"), (F.col("n_chars") >= 100).alias("readable"), F.col("quality").isNull().alias("needs_ocr")))


def category_report(spark, d):
    rules = spark.createDataFrame(CATEGORIES, "doc_type string, category string")
    order = spark.createDataFrame([("legal", 0), ("texts", 1), ("empty", 2), ("other", 3)], "category string, ord int")
    return reports.category_counts(reports.categorize(doc_type_rules(spark, d), rules), order)


def concept_report(spark, d):
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 2)
    tokens = _t(spark, d, "documents").select("doc_id", F.explode(words).alias("form"))
    return reports.concept_counts(tokens, spark.createDataFrame(CONCEPTS, "form string, concept string, category string"))


def review_reasons(spark, d):
    docs = _t(spark, d, "documents").join(_t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    out = reports.review_reasons(docs, {"short": F.col("n_chars") < 100, "poor": F.col("quality") == 0, "mail": F.contains("text", F.lit("@"))})
    return out.select("doc_id", F.array_join("reasons", ",").alias("reasons"))


def weak_documents(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", (F.col("n_chars") % 100).cast("double").alias("quality"))
    return reports.select_weak(docs, 60.0, 50)


def mean_confidence(spark, d):
    return reports.mean_confidence(_t(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.when(F.col("event_id") % 7 > 0, (F.col("event_id") % 8) / 8).alias("confidence")))


def prefix_search(spark, d):
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 2)
    index = _t(spark, d, "documents").select("doc_id", F.explode(words).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    return search.prefix_search(index, ["th", "an"])


def unified_index(spark, d):
    docs = _t(spark, d, "documents").withColumn("n_pages", lines.page_estimate(F.col("text")))
    shown = docs.select("doc_id", F.col("lang").alias("doc_type"), F.col("source").alias("title"), "n_pages", F.nullif(F.regexp_extract("text", "(https?://[a-z./]+)", 1), F.lit("")).alias("url"), F.lit(None).cast("string").alias("status"))
    ranged = registers.page_ranges(shown, "doc_id", F.col("n_pages"))
    pick = lambda p: F.regexp_extract("text", p, 1)
    cards = docs.select("doc_id", F.create_map(F.lit("date"), pick("([0-9]{4}-[0-9]{2})"), F.lit("authority"), pick("([a-z0-9._]+@[a-z0-9.]+)"), F.lit("department"), F.col("source"), F.lit("parties"), pick("Copyright ([A-Za-z0-9]+)")).alias("card"))
    return package.unified_index(ranged, cards)


def package_quality(spark, d):
    docs = _t(spark, d, "documents").select(
        "doc_id", "text", lines.page_estimate(F.col("text")).alias("n_pages"), (F.size(F.split("text", "\n\n")) - 1).alias("blank_pages"), (F.regexp_count("text", F.lit("[*%&$#]")) >= 3).alias("distorted"),
        (F.col("n_chars") < 100).alias("needs_review"), F.regexp_extract("text", "([0-9]{4})", 1).alias("date"), F.regexp_extract("text", "(https?://[a-z./]+)", 1).alias("url"), F.contains("text", F.lit("\f")).alias("has_marks"),
    )
    return package.package_quality(docs, pairs.exact_duplicates(docs.select("doc_id", "text")))


def inner_inventory(spark, d):
    tree = _t(spark, d, "pages").select(F.col("url").alias("path"), F.octet_length("html").cast("long").alias("size"))
    return package.inner_inventory(package.inner_files(tree, "https?:"))


def timeline(spark, d):
    """Order dates, written with the day first, as the texts; titles and types repeat, so that dates do too."""
    day = F.col("o_orderdate").cast("date")
    texts = F.concat_ws("/", F.day(day), F.month(day), F.year(day))
    docs = _t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("doc_type"), F.lit("orders").alias("path"), texts.alias("text"))
    return package.unified_timeline(docs)


def highlights(spark, d):
    return package.highlights(_t(spark, d, "documents"), ["the"])


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents"
_TOKENS = "regexp_extract_all(text, '[\\p{L}\\p{N}_]+')"
_LONG = lambda n: f"list_distinct(list_filter({_TOKENS}, lambda x: regexp_full_match(x, '[0-9]{{{n},}}')))"
_NUMBERS = f"SELECT doc_id, 'number' AS kind, unnest({_LONG(6)}) AS value FROM documents"
_NORM = "trim(regexp_replace(lower(line), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
_TERMS = "SELECT doc_id, w AS term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS w FROM documents) WHERE length(w) >= 2 GROUP BY ALL"
_STRIP = "trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_WORDS = "SELECT doc_id, w AS term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents) WHERE length(w) >= 2 GROUP BY ALL"
_PAGES = "CASE WHEN length(trim(text)) > 0 THEN CAST(ceil(length(text) / 1800.0) AS BIGINT) ELSE 0 END"

ORACLE_SQL = {
    "line_table_stats": f"SELECT doc_id, count(*) AS n_lines, max(length(line)) AS longest, count(*) FILTER (length(line) = 0) AS blank, count(*) FILTER (regexp_matches(line, '^[0-9 .,-]+$')) AS bare FROM ({_LINES}) GROUP BY doc_id",
    "header_repeats": f"SELECT doc_id, norm, count(*) AS times, min(line_no) AS first_line FROM (SELECT doc_id, line_no, {_NORM} AS norm FROM ({_LINES})) WHERE length(norm) >= 8 GROUP BY doc_id, norm HAVING count(*) >= 2",
    "boilerplate_lines": f"WITH n AS (SELECT DISTINCT doc_id, {_NORM} AS norm FROM ({_LINES})) SELECT norm, count(*) AS docs FROM n WHERE length(norm) BETWEEN 6 AND 80 AND regexp_matches(norm, '\\p{{L}}') GROUP BY norm HAVING count(*) >= greatest(3, (SELECT ceil(count(DISTINCT doc_id) * 0.002::DOUBLE) FROM n))",
    "distortion_scores": f"SELECT doc_id, symbols, repeats, fragments, round((3 * symbols + repeats + fragments) / greatest(1.0, length(text) / 500.0), 4) AS score, concat_ws(',', CASE WHEN symbols > 0 THEN 'symbols' END, CASE WHEN repeats > 0 THEN 'repeats' END, CASE WHEN fragments > 5 THEN 'fragments' END) AS issues FROM (SELECT doc_id, text, len(regexp_extract_all(text, '[*%&$#]')) AS symbols, len(list_filter(c, lambda x, i: i >= 4 AND x = c[i - 1] AND x = c[i - 2] AND x = c[i - 3] AND (i = 4 OR x <> c[i - 4]) AND x NOT IN (' ', chr(9), chr(10), chr(11), chr(12), chr(13)))) AS repeats, len(list_filter(string_split(text, chr(10)), lambda x: length({_STRIP}) BETWEEN 1 AND 2)) AS fragments FROM (SELECT doc_id, text, string_split(text, '') AS c FROM documents))",
    "quality_metrics": findings.QUALITY,
    "doc_type_rules": f"SELECT d.doc_id, coalesce(arg_min(r.label, (CASE WHEN contains(lower(d.source), r.pattern) THEN 0 ELSE 1 END) * 100 + r.ord), 'unclassified') AS doc_type FROM documents d LEFT JOIN {_values(TYPE_RULES)} ON contains(lower(d.source), r.pattern) OR contains(lower(d.text), r.pattern) GROUP BY d.doc_id",
    "segment_rules": f"SELECT doc_id, label, string_agg(pattern, ',' ORDER BY pattern) AS keywords FROM documents JOIN {_values(SEGMENTS)} ON contains(lower(text), pattern) GROUP BY doc_id, label",
    "long_numbers": _NUMBERS,
    "number_df": f"SELECT kind, value, docs FROM (SELECT kind, value, count(*) AS docs, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, value) AS n FROM ({_NUMBERS}) GROUP BY kind, value) WHERE n <= 50",
    "qc_join_distribution": "WITH j AS (SELECT lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)) " + " UNION ALL ".join(f"SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS value, count(*) AS docs FROM j GROUP BY {c}" for c in ("lang", "quality", "toxic")),
    "exact_dups": "SELECT doc_id, first_id, copies FROM (SELECT doc_id, min(doc_id) OVER w AS first_id, count(*) OVER w AS copies FROM documents WINDOW w AS (PARTITION BY trim(text))) WHERE copies > 1",
    "same_size_groups": "SELECT n_chars, count(*) AS docs, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents WHERE n_chars > 0 GROUP BY n_chars HAVING count(*) > 1",
    "similar_titles": "WITH t AS (SELECT title, min(id) AS id FROM (SELECT p_partkey AS id, lower(concat_ws(' ', p_name, p_brand, p_type)) AS title FROM part) GROUP BY title), w AS (SELECT DISTINCT id, unnest(string_split(title, ' ')) AS w FROM t), s AS (SELECT id, count(*) AS n FROM w WHERE w <> '' GROUP BY id), m AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM w x JOIN w y ON x.w = y.w AND x.id < y.id WHERE x.w <> '' GROUP BY ALL) SELECT a, b, round(k / (p.n + q.n - k), 6) AS similarity FROM m JOIN s p ON p.id = a JOIN s q ON q.id = b WHERE k / (p.n + q.n - k) >= 0.8 - 1e-9",
    "near_dups": "WITH t AS (SELECT min(doc_id) AS id, lower(trim(text)) AS text FROM documents GROUP BY trim(text)), w AS (SELECT id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM t), g AS (SELECT DISTINCT id, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) AS g FROM w WHERE len(w) >= 5), s AS (SELECT id, count(*) AS n FROM g GROUP BY id), m AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.id < y.id GROUP BY ALL) SELECT a, b, round(k / (p.n + q.n - k), 6) AS similarity FROM m JOIN s p ON p.id = a JOIN s q ON q.id = b WHERE k / (p.n + q.n - k) >= 0.8 - 1e-9",
    "study_reconcile": "SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'both' WHEN a.id IS NOT NULL THEN 'study' ELSE 'archive' END AS found FROM (SELECT DISTINCT item_id AS id FROM benchmark) a FULL JOIN (SELECT DISTINCT doc_id AS id FROM labels) b ON a.id = b.id",
    "page_ranges": f"SELECT doc_id, page_to - p + 1 AS page_from, page_to FROM (SELECT doc_id, p, CAST(sum(p) OVER (ORDER BY doc_id) AS BIGINT) AS page_to FROM (SELECT doc_id, greatest(1, {_PAGES}) AS p FROM documents))",
    "doc_numbering": "SELECT doc_id, 'DOC-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS code FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents)",
    "run_grouping": "SELECT conv_id, run_no, size, count(*) AS turns, min(turn) AS first_turn FROM (SELECT conv_id, turn, size, CAST(sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run_no FROM (SELECT *, CASE WHEN lag(size) OVER (PARTITION BY conv_id ORDER BY turn) = size THEN 0 ELSE 1 END AS c FROM (SELECT *, CASE WHEN length(text) >= 100 THEN 'long' ELSE 'short' END AS size FROM conversations))) GROUP BY conv_id, run_no, size",
    "central_documents": f"SELECT doc_id, importance FROM (SELECT doc_id, CAST((CASE WHEN contains(lower(text), 'licen') THEN 3 ELSE 0 END) + (CASE WHEN len({_LONG(9)}) > 0 THEN 3 ELSE 0 END) + (CASE WHEN len({_LONG(6)}) > 0 THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(text, '[0-9]+\\.[0-9]') THEN 1 ELSE 0 END) + least(len(list_distinct(regexp_extract_all(text, '{MAIL}'))), 3) + (CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END) AS BIGINT) AS importance FROM documents) WHERE importance >= 3 ORDER BY importance DESC, doc_id LIMIT 25",
    "bm25_topk": f"WITH p AS ({_TERMS}), s AS (SELECT doc_id, sum(tf) AS len FROM p GROUP BY doc_id), t AS (SELECT count(*) AS n, avg(len) AS mean FROM s), h AS (SELECT * FROM p WHERE term IN ({', '.join(repr(q) for q in QUERY)})), df AS (SELECT term, count(*) AS df FROM h GROUP BY term) SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS score FROM h JOIN df USING (term) JOIN s USING (doc_id) CROSS JOIN t GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 400",
    "boolean_search": "SELECT doc_id FROM documents WHERE (contains(lower(text), 'license') OR contains(lower(text), 'token')) AND NOT contains(lower(text), 'the')",
    "word_families": f"SELECT term AS stem, CAST(sum(tf) AS BIGINT) AS times, count(*) AS docs, term AS forms FROM ({_TERMS}) GROUP BY term HAVING count(*) >= 2",
    "url_ids": "SELECT page_id, regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1) AS file_id, coalesce(nullif(coalesce(nullif(regexp_extract(replace(url, '/en/', '/d/'), '/d/([A-Za-z0-9_-]+)', 1), ''), regexp_extract(url, '[?&]id=([A-Za-z0-9_-]+)', 1)), ''), '') AS drive_id FROM pages",
    "parts_packing": "SELECT part, count(*) AS docs, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT size, CAST(floor((sum(size) OVER (ORDER BY doc_id) - size) / 200000) AS BIGINT) AS part FROM (SELECT doc_id, strlen(text) AS size FROM documents)) GROUP BY part",
    "keep_best": "SELECT decision, count(*) AS docs FROM (SELECT CASE WHEN d.n_chars % 100 >= 60 THEN 'skipped' WHEN l.q IS NULL THEN 'missing' WHEN l.q - d.n_chars % 100 > 8 THEN 'replaced' ELSE 'kept' END AS decision FROM documents d LEFT JOIN (SELECT doc_id, max(quality * 40 + doc_id % 40) AS q FROM labels GROUP BY doc_id) l USING (doc_id)) GROUP BY decision",
    "ingest_batches": "SELECT event_type, count(*) AS rows, count(DISTINCT event_id) AS ids FROM events GROUP BY event_type",
}

_HITS = " + ".join(f"(length(low) - length(replace(low, '{t}', ''))) // {len(t)}" for t in TERMS)
_SECTION = "CASE " + " ".join("WHEN " + " + ".join(f"CAST(contains(lower(line), '{w}') AS INT)" for w in ws) + f" >= {n} THEN '{name}'" for name, ws, n in SECTIONS) + " ELSE 'body' END"
_N = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> ''))"
_LIST = lambda rows: ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in rows)
_FORMS = "SELECT doc_id, w AS form FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents) WHERE length(w) >= 2"

ORACLE_SQL |= {
    "doubling_collapse": "SELECT doc_id, md5(array_to_string(list_filter(s, lambda x, i: i = 1 OR length(x) < 3 OR x <> s[i - 1]), ' ')) AS digest FROM (SELECT doc_id, list_transform(string_split(text, ' '), lambda t: CASE WHEN length(t) >= 6 AND length(t) % 2 = 0 AND regexp_matches(t, '[A-Za-z]') AND NOT regexp_matches(t, '\\p{Nd}') AND t[1:length(t) // 2] = t[length(t) // 2 + 1:] THEN t[1:length(t) // 2] ELSE t END) AS s FROM documents)",
    "learned_terms": "WITH p AS (SELECT unnest(list_concat(regexp_extract_all(text, 'the ([a-z]+ [a-z]+)', 1), regexp_extract_all(text, 'and ([a-z]+ [a-z]+)', 1))) AS phrase FROM documents), q AS (SELECT string_split(phrase, ' ') AS w, count(*) AS n FROM p GROUP BY phrase HAVING count(*) >= 2) SELECT term, CAST(sum(n) AS BIGINT) AS times FROM (SELECT unnest(w) AS term, n FROM q WHERE NOT list_has_any(w, ['of', 'to'])) GROUP BY term HAVING sum(n) >= 2",
    "lexical_density": f"SELECT doc_id, round(1000 * ({_HITS}) / greatest(length(low), 1), 4) AS density FROM (SELECT doc_id, lower(text) AS low FROM documents)",
    "readability_qc": f"WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: regexp_matches(x, '[A-Za-z]'))) AS t FROM ({_LINES})), s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (t IN ({', '.join(repr(t) for t in TERMS)}) OR (length(t) >= 3 AND len(regexp_extract_all(t, '[A-Za-z]')) > 0.7 * length(t))) AS g FROM t GROUP BY doc_id), d AS (SELECT DISTINCT doc_id FROM ({_LINES}) WHERE trim(line) <> '') SELECT doc_id, CAST(0 AS BIGINT) AS reversed_lines, round(coalesce(g / n, 0.0), 4) AS word_ratio, coalesce(n, 0) AS words, CASE WHEN n > 40 AND g / n < 0.35 THEN 'noisy' ELSE 'clean' END AS status FROM d LEFT JOIN s USING (doc_id)",
    "section_runs": f"WITH c AS (SELECT doc_id, line_no, {_SECTION} AS section FROM ({_LINES}) WHERE trim(line) <> ''), r AS (SELECT *, CAST(sum(x) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS run_no FROM (SELECT *, CASE WHEN lag(section) OVER (PARTITION BY doc_id ORDER BY line_no) = section THEN 0 ELSE 1 END AS x FROM c)) SELECT doc_id, run_no, section, min(line_no) AS first_line, count(*) AS n_lines FROM r GROUP BY doc_id, run_no, section",
    "cleaning_drift": f"SELECT *, abs(change) > 8 AS alert FROM (SELECT *, round(100 * (words_after - words_before) / greatest(words_before, 1), 2) AS change FROM (SELECT doc_id, {_N.format('text')} AS words_before, {_N.format(chr(114) + 'egexp_replace(text, ' + chr(39) + chr(92) + 'b[0-9]+' + chr(92) + 'b' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')} AS words_after FROM documents))",
    "card_fields": "SELECT doc_id, coalesce(CASE WHEN contains(head, 'license') THEN 'license' WHEN contains(head, 'token') THEN 'token' WHEN contains(head, 'the ') THEN 'the ' WHEN contains(text, 'license') THEN 'license' WHEN contains(text, 'token') THEN 'token' WHEN contains(text, 'the ') THEN 'the ' END, '') AS authority, coalesce(nullif(regexp_extract(source, '([0-9]{4,})', 1), ''), nullif(regexp_extract(head, '([0-9]{6,})', 1), ''), regexp_extract(text, '([0-9]{5,})', 1)) AS number, regexp_extract(head, '([a-z0-9._]+@[a-z0-9.]+)', 1) AS mail FROM (SELECT *, left(array_to_string(string_split(text, chr(10))[1:18], chr(10)), 1000) AS head FROM documents)",
    "financial_figures": f"SELECT doc_id, line_no, digits, unit FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, digits, unit) AS i FROM (SELECT doc_id, min(line_no) AS line_no, digits, unit FROM (SELECT doc_id, line_no, line, regexp_replace(regexp_extract(m, '^[0-9.,]+'), '[^0-9]', '', 'g') AS digits, regexp_extract(m, '({UNITS})$') AS unit FROM (SELECT doc_id, line_no, line, unnest(regexp_extract_all(line, '[0-9][0-9.,]{{0,16}}[ ]*(?:{UNITS})?')) AS m FROM ({_LINES}))) WHERE unit <> '' OR (length(digits) BETWEEN 6 AND 13 AND regexp_matches(line, '{MONEY}')) GROUP BY doc_id, digits, unit)) WHERE i <= 50",
    "study_sections": "WITH e AS (SELECT conv_id AS doc_id, turn AS pos, CASE WHEN role <> 'user' THEN length(text) END AS file_id, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations) SELECT file_id, doc_id, pos, md5(section) AS section FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY doc_id, pos) AS n FROM e WHERE file_id IS NOT NULL) WHERE n = 1",
    "study_records": "SELECT b.id AS file_id, coalesce(CASE WHEN lower(trim(d.title)) NOT IN ('link', 'web') AND trim(d.title) <> '' THEN trim(d.title) END, CASE WHEN lower(trim(b.row)) NOT IN ('link', 'web') AND trim(b.row) <> '' THEN trim(b.row) END, b.id) AS title, CASE WHEN d.id IS NULL OR d.n IS NULL THEN 'not_retrieved' WHEN d.n = 0 THEN 'empty' ELSE 'ok' END AS text_status FROM (SELECT CAST(item_id AS VARCHAR) AS id, text AS row FROM benchmark) b LEFT JOIN (SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 2 = 0 THEN source END AS title, length(trim(text)) AS n FROM documents) d ON b.id = d.id",
    "deed_register": f"SELECT number, coalesce(in_titles, 0) AS in_titles, coalesce(in_texts, 0) AS in_texts, first_doc, CASE WHEN in_titles > 0 THEN 'document' WHEN in_texts > 0 THEN 'mentioned' ELSE 'missing' END AS status FROM (VALUES {_LIST([(n,) for n in NUMBERS])}) v(number) LEFT JOIN (SELECT number, count(*) FILTER (contains(source, number)) AS in_titles, count(*) FILTER (contains(text, number)) AS in_texts, min(doc_id) AS first_doc FROM documents JOIN (VALUES {_LIST([(n,) for n in NUMBERS])}) w(number) ON contains(source, number) OR contains(text, number) GROUP BY number) USING (number)",
    "tag_spans": "SELECT doc_id, kind, value, count(*) AS times FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS value FROM documents" for k, p in SPANS.items()) + ") GROUP BY ALL",
    "central_values": f"WITH e AS (SELECT * FROM ({_NUMBERS}) WHERE length(value) >= 6) SELECT value, count(*) AS times, count(DISTINCT doc_id) AS docs, array_to_string(list_sort(list(DISTINCT source))[1:6], ',') AS samples FROM e JOIN documents USING (doc_id) GROUP BY value",
    "corpus_counts": "SELECT count(*) AS records, count(*) FILTER (f) AS files, count(*) FILTER (NOT f) AS folders, count(*) FILTER (f AND n_chars >= 100) AS readable, count(*) FILTER (f AND n_chars < 100) AS unreadable, count(*) FILTER (f AND q IS NULL) AS needs_ocr FROM (SELECT n_chars, q, coalesce(q <> 0, true) AS f FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) USING (doc_id))",
    "concept_report": f"SELECT category, concept, CAST(sum(n) AS BIGINT) AS times, count(*) AS docs FROM (SELECT category, concept, doc_id, count(*) AS n FROM ({_FORMS}) JOIN (VALUES {_LIST(CONCEPTS)}) c(form, concept, category) USING (form) GROUP BY ALL) GROUP BY category, concept",
    "review_reasons": "SELECT * FROM (SELECT doc_id, concat_ws(',', CASE WHEN n_chars < 100 THEN 'short' END, CASE WHEN quality = 0 THEN 'poor' END, CASE WHEN contains(text, '@') THEN 'mail' END) AS reasons FROM documents LEFT JOIN labels USING (doc_id)) WHERE reasons <> ''",
    "weak_documents": "SELECT doc_id, CAST(n_chars % 100 AS DOUBLE) AS quality FROM documents WHERE n_chars % 100 < 60 ORDER BY quality, doc_id LIMIT 50",
    "mean_confidence": "SELECT user_id AS doc_id, round(avg(CASE WHEN event_id % 7 > 0 THEN (event_id % 8)::DOUBLE / 8 END), 3) AS confidence, count(*) FILTER (event_id % 7 > 0) AS words FROM events GROUP BY user_id",
    "prefix_search": f"SELECT doc_id, CAST(sum(tf) AS BIGINT) AS hits FROM (SELECT doc_id, q, tf FROM ({_WORDS}) JOIN (VALUES ('th'), ('an')) v(q) ON starts_with(term, q)) GROUP BY doc_id HAVING count(DISTINCT q) = 2 ORDER BY hits DESC, doc_id LIMIT 400",
}
ORACLE_SQL["category_report"] = f"WITH t AS ({ORACLE_SQL['doc_type_rules']}), c AS (SELECT coalesce(k.category, 'other') AS category, count(*) AS docs FROM t LEFT JOIN (VALUES {_LIST(CATEGORIES)}) k(doc_type, category) USING (doc_type) GROUP BY 1) SELECT o.category, o.ord, coalesce(docs, 0) AS docs FROM (VALUES ('legal', 0), ('texts', 1), ('empty', 2), ('other', 3)) o(category, ord) LEFT JOIN c USING (category)"

_JD = "(date_diff('day', DATE '1970-01-01', d) + 492148)"
ORACLE_SQL |= {
    "unified_index": f"SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id, lang AS doc_type, source AS title, CASE WHEN regexp_matches(date, '20[0-9][0-9]') THEN '' ELSE date END AS date_hijri, CASE WHEN regexp_matches(date, '20[0-9][0-9]') THEN date ELSE '' END AS date_gregorian, coalesce(nullif(mail, ''), source, '') AS authority, owner AS parties, p AS n_pages, CAST(sum(greatest(1, p)) OVER (ORDER BY doc_id) - greatest(1, p) + 1 AS BIGINT) || '-' || CAST(sum(greatest(1, p)) OVER (ORDER BY doc_id) AS BIGINT) AS page_range, '#' || doc_id AS link, url, '' AS status FROM (SELECT *, {_PAGES} AS p, regexp_extract(text, '([0-9]{{4}}-[0-9]{{2}})', 1) AS date, regexp_extract(text, '([a-z0-9._]+@[a-z0-9.]+)', 1) AS mail, regexp_extract(text, 'Copyright ([A-Za-z0-9]+)', 1) AS owner, regexp_extract(text, '(https?://[a-z./]+)', 1) AS url FROM documents)",
    "package_quality": f"SELECT count(*) AS docs, CAST(sum(greatest(1, {_PAGES})) AS BIGINT) AS pages, CAST(sum(len(string_split(text, chr(10) || chr(10))) - 1) AS BIGINT) AS blank_pages, count(*) FILTER (len(regexp_extract_all(text, '[*%&$#]')) >= 3) AS distorted, count(*) FILTER (n_chars < 100) AS needs_review, count(*) FILTER (regexp_matches(text, 'https?://[a-z./]+')) AS with_link, count(*) FILTER (NOT regexp_matches(text, '[0-9]{{4}}')) AS no_date, count(*) FILTER (NOT regexp_matches(text, 'https?://[a-z./]+')) AS no_source, count(*) FILTER (length(trim(text)) = 0) AS no_text, count(*) FILTER (contains(text, chr(12))) AS with_page_marks, (SELECT count(*) FROM ({ORACLE_SQL['exact_dups']})) AS duplicate_pairs FROM documents",
    "inner_inventory": "SELECT archive, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, count(DISTINCT extension) AS extensions FROM (SELECT archive, size, lower(regexp_extract(name, '\\.([^./]+)$', 1)) AS extension FROM (SELECT regexp_extract(url, '^https?:/*([^/]+)/(.+)$', 1) AS archive, regexp_extract(url, '^https?:/*([^/]+)/(.+)$', 2) AS name, strlen(html) AS size FROM pages) WHERE archive <> '') GROUP BY ROLLUP (archive)",
    "timeline": f"WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS title, o_orderstatus AS doc_type, CAST(o_orderdate AS DATE) AS d FROM orders), f AS (SELECT d, title, arg_min(doc_type, k) AS doc_type FROM o GROUP BY d, title), y AS (SELECT *, {_JD} AS j, (30 * {_JD} + 10646) // 10631 AS y FROM f), m AS (SELECT *, j - 354 * (y - 1) - (3 + 11 * y) // 30 AS i FROM y), n AS (SELECT *, least(12, (2 * i) // 59 + 1) AS m FROM m) SELECT 'gregorian' AS calendar, day(d) || '/' || month(d) || '/' || year(d) AS value, CAST(year(d) * 10000 + month(d) * 100 + day(d) AS INT) AS date_key, title, doc_type, 'orders' AS path, d AS date, CAST(y * 10000 + m * 100 + i - (59 * (m - 1) + 1) // 2 + 1 AS INT) AS other_key FROM n",
    "highlights": "SELECT doc_id, e - 3 AS start_pos, e AS end_pos FROM (SELECT doc_id, i, n, CAST(sum(length(piece) + 3) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e FROM (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i, len(p) AS n FROM (SELECT doc_id, string_split(lower(text), 'the') AS p FROM documents))) WHERE i < n",
}

#: This reads each text page by page and has no SQL; test_repair.py holds it against fixtures.
NO_SQL = ("header_zones",)
QUERIES = {name: globals()[name] for name in (*ORACLE_SQL, *NO_SQL)} | casework.QUERIES | findings.QUERIES | structure.QUERIES
ORACLE_SQL |= casework.ORACLE_SQL | findings.ORACLE_SQL | structure.ORACLE_SQL
