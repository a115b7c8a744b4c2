"""Registers and reports over documents and their entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import ascii_digits, hijri_key
from scriptorium.operators.extract import constants, rule_rows, small


def readability_flags(files: DataFrame, least: int = 20, forms: float = 0.15) -> DataFrame:
    """Adds readable, needs_ocr and orientation (visual where many presentation forms stand)."""
    n = F.length(F.trim(F.coalesce("text", F.lit(""))))
    status = F.coalesce("read_status", F.lit(""))
    readable = (n >= least) & ~status.isin("error", "needs_ocr")
    shaped = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[ﭐ-﷿ﹰ-ﻼ]")) / F.greatest(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\p{L}")), F.lit(1))
    image = F.lower(F.coalesce("fileExtension", F.lit(""))).isin("jpg", "jpeg", "png", "tif", "tiff", "pdf")
    return files.withColumns({"readable": readable, "needs_ocr": (status == "needs_ocr") | (image & ~readable), "orientation": F.when(shaped > forms, "visual").otherwise("logical")})


def availability(files: DataFrame) -> DataFrame:
    """Adds availability: available, archive, image or deleted, by readability and hints in the title."""
    t = F.lower(F.coalesce("title", F.lit("")))
    kind = F.when(F.col("readable"), "available").when(t.rlike(r"\.?\b(zip|rar)\b"), "archive").when(t.rlike(r"صورة|\.(jpe?g|png)"), "image").otherwise("deleted")
    return files.withColumn("availability", kind)


def categorize(docs: DataFrame, categories: DataFrame, rest: str = "other") -> DataFrame:
    """Adds category from categories(doc_type, category)."""
    return docs.join(small(categories), "doc_type", "left").withColumn("category", F.coalesce("category", F.lit(rest)))


def category_counts(docs: DataFrame, order: DataFrame) -> DataFrame:
    """(category, ord, docs) for each category of order(category, ord), those without documents too."""
    counts = docs.groupBy("category").agg(F.count("*").alias("docs"))
    return order.join(counts, "category", "left").select("category", "ord", F.coalesce("docs", F.lit(0)).alias("docs"))


def review_reasons(docs: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """(doc_id, reasons): documents for which some condition holds, with its names."""
    found = F.array_compact(F.array(*[F.when(cond, name) for name, cond in reasons.items()]))
    return docs.select("doc_id", found.alias("reasons")).where(F.size("reasons") > 0)


def build_cards(docs: DataFrame, authorities: Sequence[str], patterns: dict[str, str], head_lines: int = 18, head_chars: int = 1000) -> DataFrame:
    """(doc_id, card): a map of authority and one field for each pattern (group 1).

    Fields come from the head of the text, `title:` patterns from the title before that, `any:` patterns from the whole text after it.
    """
    head = F.substring(F.array_join(F.slice(F.split("text", "\n"), 1, head_lines), "\n"), 1, head_chars)
    base = docs.select("doc_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(head, F.lit("")).alias("head"))
    first = lambda c: F.coalesce(*[F.when(F.contains(c, F.lit(a)), a) for a in authorities], F.lit(None).cast("string"))
    fields: dict[str, list[Column]] = {"authority": [first(F.col("head")), first(F.col("text"))]}
    for place in ("title", "head", "any"):
        for name, pattern in patterns.items():
            where, _, key = name.rpartition(":")
            if (where or "head") == place:
                fields.setdefault(key, []).append(F.nullif(F.regexp_extract("text" if place == "any" else place, pattern, 1), F.lit("")))
    entries = [F.struct(F.lit(k).alias("key"), F.coalesce(*v, F.lit(None).cast("string")).alias("value")) for k, v in fields.items()]
    return base.select("doc_id", F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull())).alias("card"))


def merge_cards(cards: DataFrame, external: DataFrame) -> DataFrame:
    """Cards with the values of external(doc_id, card) over their own; nulls and empty values there change nothing."""
    given = external.select("doc_id", F.map_filter("card", lambda k, v: v.isNotNull() & (F.trim(v) != "")).alias("_x"))
    joined = cards.join(given, "doc_id", "left").withColumn("_x", F.coalesce("_x", F.map_filter("card", lambda k, v: F.lit(False))))
    mine = F.map_filter("card", lambda k, v: ~F.array_contains(F.map_keys("_x"), k))
    return joined.select("doc_id", F.map_concat(mine, F.col("_x")).alias("card"))


def financial_figures(ls: DataFrame, units: str, money: str, own_number: str | None = None, most: int = 50) -> DataFrame:
    """(doc_id, line_no, digits, unit, context): numbers with a unit, or of 6 to 13 digits on a line about money.

    Numbers without a unit on a line with a date and no word of money are none; each (digits, unit) counts once in a document, at its first line.
    """
    pattern = rf"([0-9][0-9.,]{{0,16}})[ ]*({units})?"
    base = ls.select("doc_id", "line_no", ascii_digits(F.col("line")).alias("line")).withColumns({"_money": F.col("line").rlike(money), "_date": F.col("line").rlike(r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}")})
    hits = base.withColumn("_n", F.explode(F.arrays_zip(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)).alias("num"), F.regexp_extract_all("line", F.lit(pattern), F.lit(2)).alias("unit"))))
    hits = hits.select("doc_id", "line_no", "line", "_money", "_date", F.regexp_replace("_n.num", r"[^0-9]", "").alias("digits"), F.coalesce("_n.unit", F.lit("")).alias("unit"))
    n, named = F.length("digits"), F.col("unit") != ""
    good = hits.where(named | (n.between(6, 13) & F.col("_money"))).where(named | F.col("_money") | ~F.col("_date"))
    if own_number:
        good = good.where(F.col("digits") != own_number)
    context = F.substring(F.trim(F.regexp_replace("line", r"\s+", " ")), 1, 48)
    one = good.groupBy("doc_id", "digits", "unit").agg(F.min("line_no").alias("line_no"), F.min_by(context, "line_no").alias("context"))
    return one.withColumn("_i", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "digits", "unit"))).where(F.col("_i") <= most).select("doc_id", "line_no", "digits", "unit", "context")


def financial_annex(docs: DataFrame, figures: DataFrame) -> DataFrame:
    """(doc_id, figures): how many figures each of the financial documents holds, none included."""
    counts = figures.groupBy("doc_id").agg(F.count("*").alias("figures"))
    return docs.select("doc_id").join(counts, "doc_id", "left").fillna(0, ["figures"])


def assign_sections(elements: DataFrame) -> DataFrame:
    """(file_id, pos, section): links of elements(doc_id, pos, is_heading, text, file_id) with the latest heading above; the first link of a file counts."""
    above = F.last(F.when(F.col("is_heading"), F.col("text")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos"))
    links = elements.withColumn("section", above).where("file_id IS NOT NULL")
    return links.groupBy("file_id").agg(F.min_by(F.struct("doc_id", "pos", "section"), F.struct("doc_id", "pos")).alias("s")).select("file_id", "s.doc_id", "s.pos", "s.section")


def study_index(links: DataFrame, meta: DataFrame, texts: DataFrame, generic: Sequence[str] = ()) -> DataFrame:
    """(file_id, title, extension, text_status) of links(file_id, row_desc, anchor): the archive's title, else the row's text, the anchor's, the id; generic labels don't count."""
    named = lambda c: F.when((F.trim(c) != "") & ~F.lower(F.trim(c)).isin(list(generic)), F.trim(c))
    m, t = meta.select("file_id", F.col("title").alias("_t")), texts.select("file_id", F.length(F.trim("text")).alias("_n"))
    out = links.join(m, "file_id", "left").join(t, "file_id", "left").withColumn("title", F.coalesce(named(F.col("_t")), named(F.col("row_desc")), named(F.col("anchor")), F.col("file_id")))
    status = F.when(F.col("_n").isNull(), "not_retrieved").when(F.col("_n") == 0, "empty").otherwise("ok")
    return out.select("file_id", "title", F.lower(F.regexp_extract("title", r"\.([A-Za-z0-9]{2,5})$", 1)).alias("extension"), status.alias("text_status"))


def summary_lines(ls: DataFrame, keywords: str, shortest: int = 10, longest: int = 400) -> DataFrame:
    n = F.length(F.trim("line"))
    return ls.where((n > shortest) & (n < longest) & F.col("line").rlike(keywords))


def milestones(docs: DataFrame, keywords: str, date: str = r"(\d{1,2}[-/]\d{1,2}[-/]\d{4}|\d{4}[-/]\d{1,2}[-/]\d{1,2})") -> DataFrame:
    """(date, date_key, title, doc_id) of titles with a keyword, one for each date and start of a title; undated ones last."""
    hits = docs.where(F.col("title").rlike(keywords)).select("doc_id", "title", F.regexp_extract("title", date, 1).alias("date"))
    one = hits.groupBy("date", F.substring("title", 1, 50).alias("_start")).agg(F.min("doc_id").alias("doc_id"), F.min_by("title", "doc_id").alias("title"))
    return one.select("date", hijri_key(F.col("date")).alias("date_key"), "title", "doc_id").orderBy(F.asc_nulls_last("date_key"), "doc_id")


def deed_register(deeds: DataFrame, docs: DataFrame) -> DataFrame:
    """(number, in_titles, in_texts, first_doc, status) for each known number, found or not."""
    rows = rule_rows(deeds.select("number").where("number is not null").distinct())
    if rows is None:
        hit = docs.join(small(deeds), F.contains("title", "number") | F.contains("text", "number")).select("doc_id", "number", F.contains("title", F.col("number")).alias("in_title"), F.contains("text", F.col("number")).alias("in_text"))
    else:
        seen = lambda e: F.struct(e["number"].alias("number"), F.contains(F.col("title"), e["number"]).alias("in_title"), F.contains(F.col("text"), e["number"]).alias("in_text"))
        held = F.filter(F.transform(constants([(r.number,) for r in rows], "number"), seen), lambda e: e["in_title"] | e["in_text"])
        hit = docs.select("doc_id", F.explode(held).alias("h")).select("doc_id", "h.*")
    found = hit.groupBy("number").agg(F.count_if("in_title").alias("in_titles"), F.count_if("in_text").alias("in_texts"), F.min("doc_id").alias("first_doc"))
    out = deeds.join(found, "number", "left").fillna(0, ["in_titles", "in_texts"])
    return out.withColumn("status", F.when(F.col("in_titles") > 0, "document").when(F.col("in_texts") > 0, "mentioned").otherwise("missing"))


def tag_spans(docs: DataFrame, classes: dict[str, str]) -> DataFrame:
    """(doc_id, kind, value, times): matches of one pattern for each class."""
    tagged = lambda kind, pattern: F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    found = F.concat(*[tagged(kind, pattern) for kind, pattern in classes.items()])
    return docs.select("doc_id", F.explode(found).alias("s")).groupBy("doc_id", "s.kind", "s.value").agg(F.count("*").alias("times"))


def law_register(entity: DataFrame, kind: str, k: int = 40) -> DataFrame:
    """Distinct values of a kind of entity with their documents, the k most frequent."""
    return entity.where(F.col("kind") == kind).groupBy("value").agg(F.countDistinct("doc_id").alias("docs"), F.min("doc_id").alias("first_doc")).orderBy(F.desc("docs"), "value").limit(k)


def central_values(entity: DataFrame, titles: DataFrame, least_digits: int = 6, samples: int = 6) -> DataFrame:
    """(value, times, docs, samples): numbers of so many digits, with the first titles; the greatest first."""
    some = entity.where(F.length("value") >= least_digits)
    counts = some.groupBy("value").agg(F.count("*").alias("times"), F.countDistinct("doc_id").alias("docs"))
    named = some.select("value", "doc_id").distinct().join(titles, "doc_id").select("value", "title").distinct()
    first = named.withColumn("_i", F.row_number().over(Window.partitionBy("value").orderBy("title"))).where(F.col("_i") <= samples).groupBy("value").agg(F.array_sort(F.collect_list("title")).alias("samples"))
    return counts.join(first, "value", "left").orderBy(F.desc(F.length("value")), F.desc("value"))


def corpus_counts(files: DataFrame) -> DataFrame:
    """One row: records, files, folders, readable, unreadable, needs_ocr."""
    f = ~F.coalesce("is_folder", F.lit(False))
    return files.agg(F.count("*").alias("records"), F.count_if(f).alias("files"), F.count_if(~f).alias("folders"), F.count_if(f & F.col("readable")).alias("readable"), F.count_if(f & ~F.col("readable")).alias("unreadable"), F.count_if(f & F.col("needs_ocr")).alias("needs_ocr"))


def concept_counts(tokens: DataFrame, concepts: DataFrame) -> DataFrame:
    """(category, concept, times, docs) of tokens(doc_id, form) by concepts(form, concept, category)."""
    per_doc = tokens.groupBy("doc_id", "form").agg(F.count("*").alias("n")).join(small(concepts), "form").groupBy("category", "concept", "doc_id").agg(F.sum("n").alias("n"))
    return per_doc.groupBy("category", "concept").agg(F.sum("n").alias("times"), F.count("*").alias("docs"))


def mean_confidence(words: DataFrame) -> DataFrame:
    return words.groupBy("doc_id").agg(F.round(F.avg("confidence"), 3).alias("confidence"), F.count("confidence").alias("words"))


def select_weak(docs: DataFrame, threshold: float = 60.0, k: int = 50, targets: DataFrame | None = None) -> DataFrame:
    """Documents for another round of OCR: those named, else the k worst below the threshold."""
    if targets is not None:
        return docs.join(targets.select("doc_id").distinct(), "doc_id", "left_semi")
    return docs.where(F.col("quality") < threshold).orderBy("quality", "doc_id").limit(k)


def master_table(docs: DataFrame, date: str = r"(\d{1,2}[-/]\d{1,2}[-/]\d{4}|\d{4}[-/]\d{1,2}[-/]\d{1,2})") -> DataFrame:
    """One row for each document; the date is the title's, else the day of the last change. Where docs have them, repaired, text and summary give the text's origin, its length and the summary."""
    day = F.coalesce(F.nullif(F.regexp_extract("title", date, 1), F.lit("")), F.substring("modifiedTime", 1, 10))
    given = lambda name, kind: F.col(name) if name in docs.columns else F.lit(None).cast(kind)
    text = given("text", "string")
    origin = F.when(given("repaired", "boolean"), "repaired").when(F.length(text) > 0, "logical").otherwise("none")
    return docs.select(
        "id", "title", "doc_type", "parent_path", day.alias("date"), "fileExtension", "fileSize", "readable", "availability", "viewUrl",
        origin.alias("text_source"), F.coalesce(F.length(text), F.lit(0)).alias("n_chars"), F.coalesce(given("summary", "string"), F.lit("")).alias("summary"),
    )


def new_findings(docs: DataFrame, natures: dict[str, str], rest: str = "fact") -> DataFrame:
    """(doc_id, nature, found): documents with known deeds, amounts or case numbers, in one line each (three amounts at most).

    docs(doc_id, doc_type, deeds, amounts, cases) with arrays of strings; the nature comes from the type.
    """
    nature = F.lit(rest)
    for doc_type, name in natures.items():
        nature = F.when(F.col("doc_type") == doc_type, name).otherwise(nature)
    part = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{label}: "), F.array_join(c, ", ")))
    found = F.concat_ws(" | ", part("deeds", F.col("deeds")), part("amounts", F.slice("amounts", 1, 3)), part("cases", F.col("cases")))
    return docs.select("doc_id", nature.alias("nature"), found.alias("found")).where("found <> ''")


def summarize(docs: DataFrame, opening: int = 300) -> DataFrame:
    """(doc_id, summary): type, parties, three courts, case and deed numbers, four amounts of at most ten digits, four dates and the text's opening.

    docs(doc_id, doc_type, text, parties, courts, cases, deeds, amounts, dates), the last six arrays of strings. A tag in square
    brackets before the opening goes; parts without content are left out.
    """
    part = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{label}: "), F.array_join(c, ", ")))
    amounts = F.filter("amounts", lambda a: F.length(F.regexp_replace(a, "[^0-9]", "")) <= 10)
    start = F.substring(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), r"^\[.*?\]\s*", ""), 1, opening)
    return docs.select(
        "doc_id",
        F.concat_ws(
            " | ", F.concat(F.lit("type: "), F.coalesce("doc_type", F.lit("unclassified"))), part("parties", F.col("parties")), part("courts", F.slice("courts", 1, 3)), part("cases", F.col("cases")),
            part("deeds", F.col("deeds")), part("amounts", F.slice(amounts, 1, 4)), part("dates", F.slice("dates", 1, 4)), F.when(start != "", F.concat(F.lit("opening: "), start)),
        ).alias("summary"),
    )


def law_references(entity: DataFrame, titles: DataFrame, kinds: Sequence[str], samples: int = 5) -> DataFrame:
    """(kind, value, sources, samples): distinct titles that cite each law or article, and the first of them; the most cited first."""
    named = entity.where(F.col("kind").isin(list(kinds))).select("doc_id", "kind", "value").distinct().join(titles, "doc_id").select("kind", "value", "title").distinct()
    nth = F.row_number().over(Window.partitionBy("kind", "value").orderBy("title"))
    out = named.withColumn("_n", nth).groupBy("kind", "value").agg(F.count("*").alias("sources"), F.array_sort(F.collect_list(F.when(F.col("_n") <= samples, F.col("title")))).alias("samples"))
    return out.orderBy(F.desc("sources"), "kind", "value")


def cleaning_metrics(before: DataFrame, after: DataFrame, table: str = r"\||\t|( {3,}\S+){2}", mixed: str = r"[؀-ۿ].*[A-Za-z]{3}|[A-Za-z]{3}.*[؀-ۿ]", reversed_docs: DataFrame | None = None, review: DataFrame | None = None) -> DataFrame:
    """One row over docs(doc_id, text) before and after cleaning: documents, paragraphs (non-blank lines) and words of both, the words' change in percent,
    lines of mixed scripts and of tables before, documents to review (their words changed by more than 8 percent, or they stand in review(doc_id)) and those
    in reversed_docs(doc_id)."""
    ls = lambda c: F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))
    a = before.select("doc_id", F.coalesce("text", F.lit("")).alias("_t")).select("doc_id", F.size(ls(F.col("_t"))).alias("pb"), words(F.col("_t")).alias("wb"), F.size(F.filter(ls(F.col("_t")), lambda x: x.rlike(mixed))).alias("mx"), F.size(F.filter(ls(F.col("_t")), lambda x: x.rlike(table))).alias("tb"))
    b = after.select("doc_id", F.coalesce("text", F.lit("")).alias("_t")).select("doc_id", F.size(ls(F.col("_t"))).alias("pa"), words(F.col("_t")).alias("wa"))
    both = a.join(b, "doc_id", "left").fillna(0, ["pa", "wa"])
    flag = lambda df, given, name: df.withColumn(name, F.lit(False)) if given is None else df.join(given.select("doc_id").distinct().withColumn(name, F.lit(True)), "doc_id", "left").fillna(False, [name])
    both = flag(flag(both, review, "named"), reversed_docs, "turned")
    drift = F.abs(F.col("wa") - F.col("wb")) * 100 > F.greatest(F.col("wb"), F.lit(1)) * 8
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    out = both.agg(
        F.count("*").alias("docs"), total("pb", "paragraphs_before"), total("pa", "paragraphs_after"), total("wb", "words_before"), total("wa", "words_after"),
        total("mx", "mixed_lines"), total("tb", "table_lines"), F.count_if(drift | F.col("named")).alias("review_docs"), F.count_if("turned").alias("reversed_docs"),
    )
    return out.withColumn("change", F.round(F.when(F.col("words_before") > 0, 100 * (F.col("words_after") - F.col("words_before")) / F.col("words_before")).otherwise(0.0), 4))
