"""Repair of OCR text: direction, doubled words, learned terms, header zones, paragraphs, sections, quality checks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import bound, line_form, strip
from scriptorium.operators.lines import PAGE_MARK, run_groups

#: Brackets and their mirror images, and runs that keep their order within right-to-left text.
BRACKETS, MIRRORED = "()[]{}<>«»", ")(][}{><»«"
_RUN = r"[0-9A-Za-z٠-٩]+(?:[./:,-][0-9A-Za-z٠-٩]+)*"
_RUN_TERM = r"[0-9A-Za-z٠-٩]+"
#: Most terms of a lexicon that is written into an expression.
MOST_TERMS = 2_000


def reversed_line(c: Column) -> Column:
    """The line read backwards: brackets are mirrored, numbers and Latin runs keep their order."""
    pieces = F.reverse(F.regexp_extract_all(F.translate(c, BRACKETS, MIRRORED), F.lit(rf"(?s){_RUN}|."), F.lit(0)))
    return F.array_join(pieces, "")


def term_hits(c: Column, terms: Sequence[str]) -> Column:
    """How often any of the terms stands in the text, as a part of words too."""
    if len(terms) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms: join with a lexicon table instead")
    some = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
    count = lambda n, t: n + ((F.length(c) - F.length(F.replace(c, t, F.lit("")))) / F.length(t)).cast("int")
    return F.aggregate(some, F.lit(0), count)


def word_hits(c: Column, terms: Sequence[str]) -> Column:
    """How many whole words are terms."""
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w.isin(list(terms))))


def repair_direction(ls: DataFrame, terms: Sequence[str], conservative: bool = False) -> DataFrame:
    """(doc_id, line_no, line, changed): a line is turned around where its reversal holds more terms.

    conservative: at least five words, and the reversal has three whole-word hits and three more than the line.
    """
    both = ls.select("doc_id", "line_no", "line", reversed_line(F.col("line")).alias("_back"))
    count = word_hits if conservative else term_hits
    scored = both.withColumns({"_f": count(F.col("line"), terms), "_b": count(F.col("_back"), terms)})
    turn = F.col("_b") > F.col("_f")
    if conservative:
        turn = (F.size(F.split(F.trim("line"), r"\s+")) >= 5) & (F.col("_b") >= 3) & (F.col("_b") >= F.col("_f") + 3)
    return scored.select("doc_id", "line_no", F.when(turn, F.col("_back")).otherwise(F.col("line")).alias("line"), turn.alias("changed"))


def collapse_doubling(c: Column, script: str = "؀-ۿ") -> Column:
    """Words that are some letters twice over become these once; equal neighbours of three characters or more become one."""
    half = lambda t, a: F.substr(t, a, (F.length(t) / 2).cast("int"))
    doubled = lambda t: (F.length(t) >= 6) & (F.length(t) % 2 == 0) & t.rlike(f"[{script}]") & ~t.rlike(r"\p{Nd}") & (half(t, F.lit(1)) == half(t, (F.length(t) / 2 + 1).cast("int")))
    single = F.transform(F.split(c, " "), lambda t: F.when(doubled(t), half(t, F.lit(1))).otherwise(t))
    kept = bound(single, lambda ts: F.filter(ts, lambda t, i: (i == 0) | (F.length(t) < 3) | (t != F.get(ts, i - 1))))
    return F.array_join(kept, " ")


def learn_terms(docs: DataFrame, patterns: Sequence[str], stop: Sequence[str] = (), least: int = 2, shortest: int = 2, longest: int = 4) -> DataFrame:
    """(term, times): words of phrases that follow cues (group 1 of each pattern), of two to four words, each seen at least twice."""
    found = F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in patterns])
    phrases = docs.select(F.explode(found).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    words = phrases.withColumn("w", F.filter(F.split("phrase", r"\s+"), lambda t: t != ""))
    words = words.where(F.size("w").between(shortest, longest) & ~F.arrays_overlap("w", F.array(*map(F.lit, stop)).cast("array<string>")))
    return words.select(F.explode("w").alias("term"), "n").groupBy("term").agg(F.sum("n").alias("times")).where(F.col("times") >= least)


def header_zones(ls: DataFrame, body: str, strong: str | None = None, letters: int = 20, head: int = 12, foot: int = 3, short: int = 34) -> DataFrame:
    """Adds zone: mark, header, footer or body.

    On each page, up to `head` lines before the first line that looks like body text (pattern, or so many letters) are header;
    up to `foot` short lines right before a page mark are footer; short lines that match `strong` are header anywhere.
    """
    marked = ls.withColumns({"_m": F.col("line").rlike(PAGE_MARK), "_long": F.col("line").rlike(body) | (F.length(F.regexp_replace("line", r"[^\p{L}]", "")) >= letters)})
    along = Window.partitionBy("doc_id").orderBy("line_no")
    paged = marked.withColumn("_page", F.sum(F.col("_m").cast("int")).over(along))
    page = Window.partitionBy("doc_id", "_page")
    paged = paged.withColumns({
        "_start": F.min(F.when(F.col("_long") & ~F.col("_m"), F.col("line_no"))).over(page),
        "_end": F.max(F.when(F.col("_long"), F.col("line_no"))).over(page),
        "_first": F.min("line_no").over(page), "_last": F.max("line_no").over(page),
        "_pages": F.max("_page").over(Window.partitionBy("doc_id")),
    })
    at = F.col("line_no") - F.col("_first") + F.when(F.col("_page") == 0, 1).otherwise(0)
    header = (at <= head) & (F.coalesce(F.col("line_no") < F.col("_start"), F.lit(True))) & ~F.col("_long")
    footer = (F.col("_page") < F.col("_pages")) & (F.col("line_no") > F.col("_last") - foot) & (F.col("line_no") > F.coalesce("_end", F.lit(0)))
    zone = F.when(F.col("_m"), "mark").when(F.trim("line") == "", "body").when(header, "header").when(footer, "footer")
    if strong:
        zone = zone.when((F.length("line") <= short) & F.col("line").rlike(strong), "header")
    return paged.withColumn("zone", zone.otherwise("body")).select(*ls.columns, "zone")


#: Lines folded at once: a fold's result is copied with each line added to it, so long texts are folded in parts.
FOLD_LINES = 256


def rebuild_paragraphs(docs: DataFrame, heading: str, least: int = 40) -> DataFrame:
    """(doc_id, para_no, kind, text) of docs(doc_id, text).

    Lines without letters or digits and lines that repeat the one before go; headings (a pattern at a line's start) stand alone;
    two blank lines, or the end of a sentence once more than `least` characters are gathered, close a paragraph. That depends on
    what is gathered so far, so each text's lines are folded in order, inside the row: nothing is shuffled. Null and blank texts
    have no paragraphs; repeated ids are texts of their own.
    """
    form = lambda x: F.trim(F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " ")))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.struct(strip(x).alias("line"), form(x).alias("form")))
    kept = "array<struct<para:int,heading:boolean,line:string>>"
    zero = F.lit(0)

    def step(s: Column, x: Column) -> Column:
        line, held = x["line"], s["held"]
        blank = line == ""
        gone = blank | (x["form"] == "") | x["form"].eqNullSafe(s["before"])
        head = ~gone & line.rlike(f"^(?:{heading})")
        gathered = held + F.length(line) + F.when(held > 0, 1).otherwise(0)
        full = ~gone & F.right(line, F.lit(1)).isin(*".؟!?") & (gathered > least)
        two = blank & (s["blanks"] == 1)
        own = s["para"] + F.when(head & (held > 0), 1).otherwise(0)
        row = F.array(F.struct(own.alias("para"), head.alias("heading"), line.alias("line")))
        return F.struct(
            F.when(head | full | two, 0).when(gone, held).otherwise(gathered).alias("held"),
            F.when(blank, s["blanks"] + 1).otherwise(0).alias("blanks"),
            F.when(gone, s["before"]).otherwise(x["form"]).alias("before"),
            F.when(head, own + 1).when(full | (two & (held > 0)), s["para"] + 1).otherwise(s["para"]).alias("para"),
            F.when(gone, s["out"]).otherwise(F.concat(s["out"], row)).alias("out"),
        )

    def part(s: Column, i: Column) -> Column:
        start = F.struct(s["held"].alias("held"), s["blanks"].alias("blanks"), s["before"].alias("before"), s["para"].alias("para"), F.array().cast(kept).alias("out"))
        done = F.aggregate(F.slice("_lines", i * FOLD_LINES + 1, F.lit(FOLD_LINES)), start, step)
        return bound(done, lambda r: F.struct(r["held"].alias("held"), r["blanks"].alias("blanks"), r["before"].alias("before"), r["para"].alias("para"), F.concat(s["parts"], F.array(r["out"])).alias("parts")))

    start = F.struct(zero.alias("held"), zero.alias("blanks"), F.lit(None).cast("string").alias("before"), zero.alias("para"), F.array().cast(f"array<{kept}>").alias("parts"))
    parts = F.sequence(zero, F.floor((F.size("_lines") - 1) / FOLD_LINES).cast("int"))
    folded = docs.select("doc_id", lines.alias("_lines")).select("doc_id", F.flatten(F.aggregate(parts, start, part)["parts"]).alias("_out")).where(F.size("_out") > 0)
    places = F.sequence(F.lit(1), F.size("_out"))
    first = F.filter(places, lambda i: (i == 1) | (F.element_at("_out", i)["para"] != F.element_at("_out", F.greatest(i - 1, F.lit(1)))["para"]))
    marked = folded.withColumn("_first", first)

    def paragraph(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("_first", k + 1), F.size("_out") + 1)
        text = F.array_join(F.transform(F.slice("_out", start, end - start), lambda x: x["line"]), " ")
        kind = F.when(F.element_at("_out", start)["heading"], "heading").otherwise("para")
        return F.struct((k + 1).alias("para_no"), kind.alias("kind"), text.alias("text"))

    return marked.select("doc_id", F.explode(F.transform("_first", paragraph)).alias("p")).select("doc_id", "p.*")


def section_lines(ls: DataFrame, rules: Sequence[tuple[str, Sequence[str], int]], rest: str = "body") -> DataFrame:
    """(doc_id, run_no, section, first_line, n_lines): lines are classed by the first rule (name, keywords, least hits) that fits; like neighbours form a run."""
    low, section = F.lower("line"), None
    for name, words, least in rules:
        hits = sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
        section = F.when(hits >= least, name) if section is None else section.when(hits >= least, name)
    classed = ls.where(F.trim("line") != "").withColumn("section", section.otherwise(rest) if section is not None else F.lit(rest))
    runs = run_groups(classed, ["doc_id"], ["line_no"], "section")
    return runs.groupBy("doc_id", "run_no", "section").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"))


def lexical_density(docs: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Term hits in 1,000 characters."""
    return docs.select("doc_id", F.round(1000 * term_hits(F.lower("text"), terms) / F.greatest(F.length("text"), F.lit(1)), 4).alias("density"))


def readability_qc(ls: DataFrame, terms: Sequence[str], script: str = "؀-ۿ", words: int = 40, ratio: float = 0.35) -> DataFrame:
    """(doc_id, reversed_lines, word_ratio, words, status): plausible words are terms, or three characters or more, mostly of the script."""
    full = ls.where(F.trim("line") != "")
    tokens = F.filter(F.split("line", r"\s+"), lambda t: t.rlike(f"[{script}]"))
    whole = lambda t: t.rlike(rf"\A[{script}]+\z")  # noqa: E731  (all of it is script, so its letters need no counting)
    good = lambda t: t.isin(list(terms)) | ((F.length(t) >= 3) & (whole(t) | (F.regexp_count(t, F.lit(f"[{script}]")) > 0.7 * F.length(t))))
    counts = bound(tokens, lambda ts: F.struct(F.size(ts).cast("long").alias("n"), F.size(F.filter(ts, good)).cast("long").alias("g")))
    # a run of digits and Latin letters stands whole in the reversed line: terms of these alone have as many hits there, and tell nothing
    telling = [t for t in terms if not re.fullmatch(_RUN_TERM, t)]
    turned = term_hits(reversed_line(F.col("line")), telling) > term_hits(F.col("line"), telling) if telling else F.lit(False)
    per_line = full.select("doc_id", turned.cast("long").alias("r"), counts.alias("_c")).select("doc_id", "r", "_c.n", "_c.g")
    sums = per_line.groupBy("doc_id").agg(F.sum("r").alias("reversed_lines"), F.sum("n").alias("words"), F.sum("g").alias("g"))
    share = F.when(F.col("words") > 0, F.col("g") / F.col("words")).otherwise(0.0)
    status = F.when(F.col("reversed_lines") > 0, "reversed").when((F.col("words") > words) & (share < ratio), "noisy").otherwise("clean")
    return sums.select("doc_id", "reversed_lines", F.round(share, 4).alias("word_ratio"), "words", status.alias("status"))


def worst_readability(qc: DataFrame) -> DataFrame:
    return qc.orderBy(F.col("status") == "clean", F.desc("reversed_lines"), "word_ratio", "doc_id")


def cleaning_drift(before: DataFrame, after: DataFrame, most: float = 8.0) -> DataFrame:
    """(doc_id, words_before, words_after, change, alert): change in percent."""
    words = lambda d, name: d.select("doc_id", F.size(F.filter(F.split("text", r"\s+"), lambda t: t != "")).cast("long").alias(name))
    change = F.round(100 * (F.col("words_after") - F.col("words_before")) / F.greatest(F.col("words_before"), F.lit(1)), 2)
    return words(before, "words_before").join(words(after, "words_after"), "doc_id").withColumn("change", change).withColumn("alert", F.abs("change") > most)


def same_lines(ls: DataFrame) -> DataFrame:
    """Lines with their rank among equal lines of the document, in normal form."""
    w = Window.partitionBy("doc_id", "norm")
    return ls.withColumn("norm", line_form(F.col("line"))).withColumn("times", F.count("*").over(w)).withColumn("nth", F.row_number().over(w.orderBy("line_no")))
