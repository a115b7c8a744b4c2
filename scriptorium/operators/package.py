"""The package of a case: unified index, quality report, inner files of archives, timelines, highlights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import ALEF, ARABIC_DIGITS, MARKS, PERSIAN_DIGITS, bound, date_to_hijri, gregorian_key, hijri_key, hijri_to_date
from scriptorium.operators.extract import GREGORIAN, HIJRI, dates
from scriptorium.operators.registers import running_total

#: Letters that stand for each other in search, by the form that search uses.
_ALIKE = {"ا": ALEF, "ي": "ىئ", "ه": "ة", "و": "ؤ"} | {str(i): a + p for i, (a, p) in enumerate(zip(ARABIC_DIGITS, PERSIAN_DIGITS, strict=True))}
_FORM = {c: form for form, others in _ALIKE.items() for c in others}


def unified_index(docs: DataFrame, cards: DataFrame, order: str = "doc_id") -> DataFrame:
    """One row for each document, numbered along a unique column, with its card's fields.

    docs(doc_id, doc_type, title, n_pages, page_from, page_to, url, status); cards(doc_id, card) with the keys date, authority,
    department and parties. A date that holds a year 20.. counts as Gregorian, any other as Hijri; what a card lacks is empty.
    """
    numbered = running_total(docs, order, F.lit(1).cast("long"), "n")
    field = lambda k: F.coalesce(F.col("card")[k], F.lit(""))
    date = field("date")
    western = date.rlike(r"20\d\d")
    return numbered.join(cards.select("doc_id", "card"), "doc_id", "left").select(
        "n", "doc_id", "doc_type", "title", F.when(western, "").otherwise(date).alias("date_hijri"), F.when(western, date).otherwise("").alias("date_gregorian"),
        F.coalesce(F.nullif(field("authority"), F.lit("")), field("department")).alias("authority"), field("parties").alias("parties"), "n_pages",
        F.concat_ws("-", "page_from", "page_to").alias("page_range"), F.concat(F.lit("#"), F.col("doc_id").cast("string")).alias("link"),
        F.coalesce("url", F.lit("")).alias("url"), F.coalesce("status", F.lit("")).alias("status"),
    )


def package_quality(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row of counts over docs(n_pages, blank_pages, distorted, needs_review, date, url, text, has_marks), and the number of duplicate pairs.

    A document without pages counts as one page; null flags count as false.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    counts = docs.agg(
        F.count("*").alias("docs"), F.coalesce(F.sum(F.greatest("n_pages", F.lit(1))), F.lit(0)).alias("pages"), F.coalesce(F.sum("blank_pages"), F.lit(0)).alias("blank_pages"),
        F.count_if("distorted").alias("distorted"), F.count_if("needs_review").alias("needs_review"), F.count_if(~empty("url")).alias("with_link"), F.count_if(empty("date")).alias("no_date"),
        F.count_if(empty("url")).alias("no_source"), F.count_if(F.length(F.trim(F.coalesce("text", F.lit("")))) == 0).alias("no_text"), F.count_if("has_marks").alias("with_page_marks"),
    )
    # two tables of one row each
    return counts.withColumn("_k", F.lit(1)).join(pairs.agg(F.count("*").alias("duplicate_pairs")).withColumn("_k", F.lit(1)), "_k").drop("_k")


def inner_files(tree: DataFrame, root: str) -> DataFrame:
    """(archive, name, extension, size) of tree(path, size): the first folder below root (a pattern) is the archive; files outside of archives are left out."""
    pattern = rf"^{root}/*([^/]+)/(.+)$"
    files = tree.select(F.regexp_extract("path", pattern, 1).alias("archive"), F.regexp_extract("path", pattern, 2).alias("name"), "size").where("archive <> ''")
    return files.select("archive", "name", F.lower(F.regexp_extract("name", r"\.([^./]+)$", 1)).alias("extension"), "size")


def inner_inventory(files: DataFrame) -> DataFrame:
    """(archive, files, bytes, extensions) for each archive, and a row without archive for all."""
    return files.rollup("archive").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.countDistinct("extension").alias("extensions"))


def timeline(docs: DataFrame, calendar: str) -> DataFrame:
    """(calendar, value, date_key, title, doc_type, path): each date of docs(doc_id, title, doc_type, path, text) once for a title, by date.

    calendar: hijri or gregorian. Of documents with the same title the smallest doc_id gives type and path.
    """
    pattern, key = {"hijri": (HIJRI, hijri_key), "gregorian": (GREGORIAN, gregorian_key)}[calendar]
    found = docs.select("doc_id", "title", "doc_type", "path", F.explode(dates(F.col("text"), pattern)).alias("value")).withColumn("value", F.trim("value"))
    once = found.groupBy("value", "title").agg(F.min(F.struct("doc_id", "doc_type", "path")).alias("first"))
    out = once.select(F.lit(calendar).alias("calendar"), "value", key(F.col("value")).alias("date_key"), "title", "first.doc_type", "first.path")
    return out.orderBy("date_key", "value", "title")


def unified_timeline(docs: DataFrame) -> DataFrame:
    """Both timelines in one, with the real date and the key in the other calendar (tabular, so a day off at times). Impossible dates have neither."""
    hijri, west = timeline(docs, "hijri"), timeline(docs, "gregorian")
    real = hijri.withColumn("date", F.when(F.floor(F.col("date_key") / 100) % 100 <= 12, hijri_to_date(F.col("date_key"))))
    real = real.withColumn("other_key", F.date_format("date", "yyyyMMdd").cast("int"))
    west = west.withColumn("date", F.try_to_timestamp(F.col("date_key").cast("string"), F.lit("yyyyMMdd")).cast("date"))
    west = west.withColumn("other_key", date_to_hijri(F.col("date")))
    return real.unionByName(west).orderBy("date", "calendar", "value", "title")


def _loose(term: str) -> str:
    """A pattern for a term in which letters stand for their look-alikes and any marks may follow a letter."""
    out = []
    for c in term:
        if c in MARKS:
            continue
        form = _FORM.get(c, c)
        letters = form + _ALIKE.get(form, "")
        out.append(("[" + letters + "]" if len(letters) > 1 else "\\" + form if not form.isalnum() else form) + f"[{MARKS}]*")
    return "(?iu)" + "".join(out)


#: Occurrences folded at once: a fold's result is copied with each range added to it.
FOLD_HITS = 256


def occurrence_ranges(text: Column, terms: Sequence[str]) -> Column:
    """An array of (start_pos, end_pos): where a text holds one of the terms, overlapping ranges merged; see highlights.

    Two passes of one alternation over the text, whatever the number of terms: at each place the longest term that begins there.
    Terms that can overlap themselves are looked for one by one, each behind its last occurrence.
    """
    kind = "array<struct<start_pos:long,end_pos:long>>"
    form = lambda t: "".join(_FORM.get(c, c) for c in t if c not in MARKS).casefold()
    # of alternatives the first counts: one with more letters covers those that begin like it
    known = {form(t): _loose(t).removeprefix("(?iu)") for t in sorted(terms, key=lambda t: -len(form(t))) if form(t)}
    alone = [f for f in known if any(f[k:] == f[: len(f) - k] for k in range(1, len(f)))]
    plain = [p for f, p in known.items() if f not in alone]
    patterns = ([f"(?iu)(?=({'|'.join(plain)}))"] if plain else []) + [f"(?iu)({known[f]})" for f in alone]
    if not patterns:
        return F.array().cast(kind)
    own = F.translate(text, "\x01", "\x02")  # U+0001 marks the places below

    def steps_of(pattern: str) -> Column:
        pieces = F.split(F.regexp_replace(own, pattern, "\x01" if "(?=" in pattern else "\x01$1"), "\x01", -1)
        sizes = F.transform(F.regexp_extract_all(own, F.lit(pattern), F.lit(1)), F.length)
        return F.zip_with(F.slice(pieces, F.lit(1), F.size(pieces) - 1), sizes, lambda p, n: F.struct(F.length(p).cast("long").alias("step"), n.cast("long").alias("size")))

    zero = F.lit(0).cast("long")
    none = F.array().cast(kind)

    def add(s: Column, x: Column) -> Column:
        at = s["at"] + x["step"]
        opens = at >= s["end"]
        last = F.array(F.struct(s["start"].alias("start_pos"), s["end"].alias("end_pos")))
        return F.struct(
            at.alias("at"), F.when(opens, at).otherwise(s["start"]).alias("start"), F.when(opens, at + x["size"]).otherwise(F.greatest(s["end"], at + x["size"])).alias("end"),
            F.when(opens & (s["end"] > 0), F.concat(s["out"], last)).otherwise(s["out"]).alias("out"),
        )

    def part(all_steps: Column):
        def run(s: Column, i: Column) -> Column:
            start = F.struct(s["at"].alias("at"), s["start"].alias("start"), s["end"].alias("end"), none.alias("out"))
            done = F.aggregate(F.slice(all_steps, i * FOLD_HITS + 1, F.lit(FOLD_HITS)), start, add)
            return bound(done, lambda r: F.struct(r["at"].alias("at"), r["start"].alias("start"), r["end"].alias("end"), F.concat(s["parts"], F.array(r["out"])).alias("parts")))

        return run

    start = F.struct(zero.alias("at"), zero.alias("start"), zero.alias("end"), F.array().cast(f"array<{kind}>").alias("parts"))
    end = lambda s: F.concat(F.flatten(s["parts"]), F.when(s["end"] > 0, F.array(F.struct(s["start"].alias("start_pos"), s["end"].alias("end_pos")))).otherwise(none))
    folded = lambda x: bound(F.aggregate(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / FOLD_HITS).cast("int")), start, part(x)), end)
    found = [F.when(F.coalesce(own.rlike(p), F.lit(False)), bound(steps_of(p), folded)).otherwise(none) for p in patterns]
    if len(found) == 1:
        return found[0]
    again = lambda rs: F.transform(rs, lambda r, i: F.struct((r["start_pos"] - F.when(i == 0, zero).otherwise(F.get(rs, F.greatest(i - 1, F.lit(0)))["start_pos"])).alias("step"), (r["end_pos"] - r["start_pos"]).alias("size")))
    return bound(bound(F.array_sort(F.concat(*found)), again), lambda x: F.when(F.size(x) > 0, folded(x)).otherwise(none))


def highlights(docs: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(doc_id, start_pos, end_pos): where docs(doc_id, text) hold one of the terms, on the text as written; overlapping ranges are one.

    Positions count characters from 0, ends are exclusive. Letters match their look-alikes, marks between letters don't hinder.
    Terms that overlap each other count all; a term's next occurrence is looked for behind its last one. Null texts hold none.
    All is done inside the row that holds the text.
    """
    return docs.select("doc_id", F.explode(occurrence_ranges(F.col("text"), terms)).alias("r")).select("doc_id", "r.*")
