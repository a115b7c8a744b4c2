"""Line, page and paragraph jobs. A line is what stands between newlines, numbered from 1 within its document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import bound, clamp, line_form, nfkc, strip
from scriptorium.operators.package import occurrence_ranges

PAGE_MARK = r"\[صفحة\s*([0-9٠-٩]+)\]"


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line)"""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).select("doc_id", (F.col("n") + 1).alias("line_no"), "line")


def flag_lines(ls: DataFrame) -> DataFrame:
    """Adds tags: bare numbers or symbols, Latin words inside a right-to-left line, hints of a table."""
    c = F.col("line")
    tags = F.array_compact(
        F.array(
            F.when(F.trim(c).rlike(r"^[\p{N}\p{P}\p{S}\s]+$"), "bare"),
            F.when(c.rlike(r"[؀-ۿ]") & c.rlike("[A-Za-z]{3}"), "mixed"),
            F.when(c.rlike(r"\||\t|( {3,}\S+){2}"), "table"),
        )
    )
    return ls.withColumn("tags", tags)


def clean_lines(ls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cleaned lines, and per document how many lines each rule changed."""
    rules = {
        "controls": (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""),
        "decoration": (r"[_=*#~•·.-]{4,}", " "),
        "spaces": (r"[ \t ]{2,}", " "),
        "punctuation": (r" +([,;:.!?،؛؟])", "$1"),
    }
    out, before, stats = ls, F.col("line"), []
    for name, (pattern, to) in rules.items():
        after = F.regexp_replace(before, pattern, to)
        stats.append(F.sum((after != before).cast("long")).alias(name))
        before = after
    return out.withColumn("line", F.trim(before)), ls.groupBy("doc_id").agg(*stats)


def repeated_headers(ls: DataFrame, pattern: str | None = None, least: int = 8) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): lines whose normal form comes at least twice in their document; the first one is marked as identity."""
    w = Window.partitionBy("doc_id", "norm")
    marked = ls.withColumn("norm", line_form(F.col("line")))
    marked = marked.withColumn("times", F.count("*").over(w)).withColumn("nth", F.row_number().over(w.orderBy("line_no")))
    hit = (F.length("norm") >= least) & (F.col("times") >= 2)
    hit = hit & F.col("line").rlike(pattern) if pattern else hit
    return marked.where(~hit).select("doc_id", "line_no", "line"), marked.where(hit).withColumn("identity", F.col("nth") == 1)


def header_report(removed: DataFrame, k: int = 300) -> DataFrame:
    return removed.groupBy("norm").agg(F.count("*").alias("times"), F.countDistinct("doc_id").alias("docs"), F.min("line").alias("sample")).orderBy(F.desc("times"), "norm").limit(k)


def boilerplate(ls: DataFrame, least_docs: int = 10, share: float = 0.06, shortest: int = 6, longest: int = 80) -> DataFrame:
    """Normal forms of lines that stand in at least max(least_docs, share of all documents)."""
    norm = ls.select("doc_id", line_form(F.col("line")).alias("norm")).where(F.length("norm").between(shortest, longest) & F.col("norm").rlike(r"\p{L}")).distinct()
    n = ls.agg(F.countDistinct("doc_id").alias("n"))
    return norm.groupBy("norm").agg(F.count("*").alias("docs")).join(F.broadcast(n), F.col("docs") >= F.greatest(F.lit(least_docs), F.ceil(F.col("n") * share))).select("norm", "docs")


def drop_repeats(ls: DataFrame) -> DataFrame:
    """Without lines that equal the last line kept, in normal form; blank lines neither count nor reset."""
    full = ls.withColumn("norm", line_form(F.col("line"))).where("norm <> ''")
    before = F.lag("norm").over(Window.partitionBy("doc_id").orderBy("line_no"))
    return full.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.col("norm"))).select("doc_id", "line_no", "line")


def split_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, page_no, text): what precedes the first page mark is page 0; a text without marks is page 1."""
    ls = lines(docs).withColumn("mark", F.regexp_extract("line", PAGE_MARK, 1))
    ls = ls.withColumn("run", F.sum((F.col("mark") != "").cast("int")).over(Window.partitionBy("doc_id").orderBy("line_no")))
    number = F.translate(F.max("mark"), "٠١٢٣٤٥٦٧٨٩", "0123456789")
    pages = ls.groupBy("doc_id", "run").agg(
        number.alias("no"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("mark") == "", F.struct("line_no", "line")))), lambda s: s["line"]), "\n").alias("text")
    )
    marked = F.max("run").over(Window.partitionBy("doc_id")) > 0
    return pages.withColumn("page_no", F.when(~marked, 1).when(F.col("run") == 0, 0).otherwise(F.expr("try_cast(no AS int)"))).select("doc_id", "page_no", "text").where("page_no > 0 OR trim(text) <> ''")


def blank_pages(pages: DataFrame) -> DataFrame:
    return pages.where(F.length(F.regexp_replace("text", r"[\s\p{N}\p{P}]+", "")) < 3)


def distortion(docs: DataFrame, symbols: str = "[�■□¤]") -> DataFrame:
    """Bad symbols, characters four times in a row and fragment lines, a score by length, and the issues found (fragments from six on)."""
    c = F.coalesce("text", F.lit(""))
    parts = docs.select(
        "doc_id", F.length(c).alias("_n"),
        F.regexp_count(c, F.lit(symbols)).alias("symbols"),
        F.regexp_count(c, F.lit(r"([^\s])\1{3,}")).alias("repeats"),
        F.size(F.filter(F.split(c, "\n"), lambda x: F.length(strip(x)).between(1, 2))).alias("fragments"),
    )
    score = (3 * F.col("symbols") + F.col("repeats") + F.col("fragments")) / F.greatest(F.lit(1.0), F.col("_n") / 500)
    issues = F.array_compact(F.array(F.when(F.col("symbols") > 0, "symbols"), F.when(F.col("repeats") > 0, "repeats"), F.when(F.col("fragments") > 5, "fragments")))
    return parts.select("doc_id", "symbols", "repeats", "fragments", F.round(score, 4).alias("score"), issues.alias("issues"))


def quality_metrics(docs: DataFrame, script: str = r"؀-ۿ", other: str = "A-Za-z", compatibility: bool = False) -> DataFrame:
    """Counts and shares of the wanted script, other letters, bad symbols, short and number lines; quality 0 to 100 and risk.

    `compatibility` turns presentation forms into letters first (a Python hop). No text counts as empty.
    """
    t = F.coalesce("text", F.lit(""))
    count = lambda p: F.regexp_count("_t", F.lit(p))
    size = lambda c: F.greatest(c, F.lit(1))
    ls = docs.select("doc_id", (nfkc(t) if compatibility else t).alias("_t")).withColumn("_ls", F.filter(F.transform(F.split("_t", "\n"), strip), lambda x: x != ""))
    n = ls.select(
        "doc_id", F.length("_t").alias("chars"), F.size(F.filter(F.split("_t", r"\s+"), lambda x: x != "")).alias("words"), F.size("_ls").alias("_lines"),
        count(f"[{script}]").alias("script_letters"), count(r"\p{L}").alias("_letters"), count("[�□¿⸻]").alias("bad_symbols"), count(f"[{script}][{other}]|[{other}][{script}]").alias("mixed"),
        F.size(F.filter("_ls", lambda x: F.length(x) <= 2)).alias("short_lines"),
        F.size(F.filter("_ls", lambda x: x.rlike(r"^[0-9٠-٩\s.\-_،|]+$"))).alias("number_lines"),
    )
    base = n.withColumns({
        "other_letters": F.col("_letters") - F.col("script_letters"), "script_ratio": F.col("script_letters") / size(F.col("_letters")),
        "line_ratio": 1 - F.col("short_lines") / size(F.col("_lines")), "bad": F.col("bad_symbols") / size(F.col("chars")), "fragments": F.col("short_lines") / size(F.col("_lines")),
    })
    q = clamp(100 * (0.55 * F.col("script_ratio") + 0.30 * F.col("line_ratio") - 20 * F.col("bad") - 0.15 * F.col("fragments")))
    return base.drop("_lines", "_letters").withColumn("quality", F.round(q, 1)).withColumn("risk", F.round(100 - q, 1))


def run_groups(df: DataFrame, part: list[str], order: list[str], category: str) -> DataFrame:
    """Adds run_no: it rises where the category changes along the order."""
    w = Window.partitionBy(*part).orderBy(*order)
    changed = F.coalesce(F.lag(category).over(w) != F.col(category), F.lit(True)).cast("int")
    return df.withColumn("_c", changed).withColumn("run_no", F.sum("_c").over(w)).drop("_c")


#: Characters of the blocks that contexts are cut from: finding a place in a text takes time in proportion to what stands before it.
BLOCK = 256


def kwic(docs: DataFrame, terms: str | Sequence[str], before: int = 32, after: int = 40) -> DataFrame:
    """(doc_id, pos, context, times): where docs(doc_id, text) hold a term as written or in look-alike letters, and how often.

    Overlapping hits are one. Contexts are cut in the row that holds the text, from blocks of it, so texts meet nothing and are
    neither copied nor walked through for each hit.
    """
    ranges = docs.select("doc_id", "text", occurrence_ranges(F.col("text"), [terms] if isinstance(terms, str) else list(terms)).alias("_ranges"))

    def hit(blocks: Column, r: Column) -> Column:
        pos, end = r["start_pos"], r["end_pos"]
        start = F.greatest(pos - before, F.lit(0)).cast("int")
        size = (F.least(F.lit(before), pos) + end - pos + after).cast("int")
        first, last = F.floor(start / BLOCK).cast("int"), F.floor((start + size - 1) / BLOCK).cast("int")
        near = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
        return F.struct(pos.alias("pos"), F.substr(near, start - first * BLOCK + 1, size).alias("context"))

    blocks = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))
    hits = bound(blocks, lambda b: F.transform("_ranges", lambda r: hit(b, r)))
    each = ranges.where(F.size("_ranges") > 0).select("doc_id", F.size("_ranges").cast("long").alias("times"), F.explode(hits).alias("h"))
    return each.select("doc_id", "h.pos", "h.context", "times")


def page_estimate(text: Column, per_page: int = 1800) -> Column:
    """Page marks if there are any, else by length; 0 for no text."""
    marks = F.regexp_count(text, F.lit(PAGE_MARK))
    return F.when(marks > 0, marks).when(F.length(F.trim(text)) > 0, F.ceil(F.length(text) / per_page)).otherwise(0).cast("long")
