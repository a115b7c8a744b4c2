"""Extraction and classification; lexicons are tables (kind, label, pattern, ord)."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scriptorium.functions.text import ascii_digits, audit_form, strip
from scriptorium.plans.session import shared_table

#: No letter, digit or underscore beside a match.
_L, _R = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: Fixed values: dates with the year first or last.
HIJRI = rf"{_L}(?:1[34]\d{{2}}\s*[/-]\s*\d{{1,2}}\s*[/-]\s*\d{{1,2}}|\d{{1,2}}\s*[/-]\s*\d{{1,2}}\s*[/-]\s*1[34]\d{{2}}){_R}"
GREGORIAN = rf"{_L}(?:(?:19|20)\d{{2}}\s*[/-]\s*\d{{1,2}}\s*[/-]\s*\d{{1,2}}|\d{{1,2}}\s*[/-]\s*\d{{1,2}}\s*[/-]\s*(?:19|20)\d{{2}}){_R}"
#: Fixed values but for the currencies دولار, SAR, USD and EUR, which are added: a number before a currency or after a cue word, and words that multiply it, all in the normal form of audit_form.
MONEY = r"([0-9][0-9.,٬]{2,})\s*(?:ريالا?|ر\.?س\.?|دولار|SAR|USD|EUR)"
CUE = r"(?:مبلغ|قدره|وقدره|بمبلغ|قيمته|بقيمه)\s*([0-9][0-9.,٬]{2,})"
MAGNITUDES = {"مليون": 1_000_000, "ملايين": 1_000_000, "الف": 1_000, "الاف": 1_000, "مليار": 1_000_000_000}
#: Small tables up to so many rows are sent to all tasks; larger ones are left to the planner.
LEXICON_ROWS = 10_000
#: Rule lists up to so many rows become constants of one expression, so that each text is read once and nothing is joined.
RULE_ROWS = 500


def small(lexicon: DataFrame, most: int = LEXICON_ROWS) -> DataFrame:
    """Broadcast hint for a table whose size has been checked."""
    return F.broadcast(lexicon) if lexicon.limit(most + 1).count() <= most else lexicon


def rule_rows(rules: DataFrame) -> list[Row] | None:
    """The rows of a short rule list; None if it is longer than RULE_ROWS."""
    rows = rules.limit(RULE_ROWS + 1).collect()
    return rows if len(rows) <= RULE_ROWS else None


def constants(rows: Sequence[tuple[str, ...]], *names: str) -> Column:
    """An array of structs of strings as a constant."""
    kind = "array<struct<" + ",".join(f"{n}:string" for n in names) + ">>"
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows]).cast(kind)


def entities(docs: DataFrame, kind: str, values: Column) -> DataFrame:
    """The long form (doc_id, kind, value) of an array column."""
    return docs.select("doc_id", F.lit(kind).alias("kind"), F.explode(F.array_distinct(values)).alias("value"))


def long_numbers(text: Column, least: int = 6) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(ascii_digits(text), F.lit(rf"(?<![\p{{L}}\p{{N}}_])(\d{{{least},}})(?![\p{{L}}\p{{N}}_])"), F.lit(1))))


def dates(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(ascii_digits(text), F.lit(pattern), F.lit(0)))


def extract_amounts(docs: DataFrame, money: str = MONEY, cue: str = CUE, magnitudes: dict[str, int] = MAGNITUDES, reach: int = 12) -> DataFrame:
    """(doc_id, amount_key, amount_value, scaled_value, shown): numbers with a currency or after a cue word (group 1 of each pattern).

    Keys are digits only, of 4 to 13 digits, or fewer where one of the magnitudes stands within `reach` characters after;
    scaled_value is multiplied by it, amount_value is as written. Of equal keys of a document the largest values stand.
    """
    text = docs.select("doc_id", audit_form(F.col("text")).alias("t"))

    def found(pattern: str) -> Column:
        both = [F.regexp_extract_all("t", F.lit(rf"(?:{pattern})(?=((?s:.{{0,{reach}}})))"), F.lit(g)) for g in (1, 2)]
        return F.zip_with(*both, lambda raw, after: F.struct(raw.alias("raw"), after.alias("after")))

    rows = text.select("doc_id", F.explode(F.concat(found(money), found(cue))).alias("a")).select("doc_id", "a.*")
    factor = F.lit(1).cast("long")
    for word, by in magnitudes.items():
        factor = F.when(F.contains("after", F.lit(word)), F.greatest(factor, F.lit(by).cast("long"))).otherwise(factor)
    key = F.regexp_replace("raw", "[^0-9]", "")
    value = F.expr("try_cast(regexp_replace(rtrim('.,', raw), '[,٬]', '') AS decimal(20,2))")
    kept = rows.select("doc_id", key.alias("amount_key"), value.alias("v"), factor.alias("f")).where(F.length("amount_key").between(1, 13) & ((F.length("amount_key") >= 4) | (F.col("f") > 1)))
    one = kept.groupBy("doc_id", "amount_key").agg(F.max("v").alias("amount_value"), F.max((F.col("v") * F.col("f")).cast("decimal(32,2)")).alias("scaled_value"))
    return one.withColumn("shown", F.format_number(F.col("amount_key").cast("long"), 0))


#: Letters of the patterns that one automaton holds, and so about what is sent to all tasks at once.
AUTOMATON_LETTERS = 4_000_000


def _automaton(patterns: list[str]):
    """An automaton over distinct patterns, with the places of equal ones; and the places of empty ones, which every text holds."""
    import ahocorasick

    places: dict[str, list[int]] = {}
    for i, p in enumerate(patterns):
        places.setdefault(p, []).append(i)
    empty = places.pop("", [])
    machine = ahocorasick.Automaton()
    for p, at in places.items():
        machine.add_word(p, at)
    machine.make_automaton()
    return machine, empty


def held_patterns(texts: DataFrame, lexicon: DataFrame, mirrored: bool = False) -> DataFrame:
    """(doc_id, columns of the lexicon) for each row of lexicon(pattern, ...) whose pattern stands in a text of texts(doc_id, text).

    For lexicons too long to be constants: each text is read once by an automaton over all patterns, in Arrow batches, whatever
    their number; with `mirrored`, patterns written backwards count too. An automaton has AUTOMATON_LETTERS letters or so, and
    longer lexicons are cut by a hash of the pattern into as many parts, each read by a pass of its own, so what is sent to tasks
    is bounded. Null texts and patterns meet nothing; rows are given once for each text row. Nothing is shuffled.
    """
    lexicon = lexicon.where("pattern IS NOT NULL")
    letters = lexicon.agg(F.sum(F.octet_length("pattern")).alias("n")).first().n or 0
    parts = max(1, -(-letters * (2 if mirrored else 1) // AUTOMATON_LETTERS))
    id_type = texts.schema["doc_id"]
    schema = T.StructType([id_type, *lexicon.schema.fields])
    rows = texts.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    at = lexicon.columns.index("pattern")
    out = None
    for k in range(parts):
        part = lexicon if parts == 1 else lexicon.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == k)
        sent = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in part.collect()])

        def run(batches, sent=sent):
            own = sent.value
            patterns = [r[at] for r in own]
            machine, empty = _automaton(patterns + [p[::-1] for p in patterns] if mirrored else patterns)
            n, arrow = len(own), None
            for batch in batches:
                arrow = arrow or to_arrow_schema(schema)
                values = pa.table([pa.array(c, f.type) for c, f in zip(zip(*own) if own else [[]] * (len(arrow) - 1), list(arrow)[1:], strict=True)], names=arrow.names[1:])
                which, held = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    found = {p % n for p in empty}
                    if len(machine):
                        for _, places in machine.iter(text):
                            found.update(p % n for p in places)
                    which += [i] * len(found)
                    held += sorted(found)
                for a in range(0, len(which), 10_000):
                    got = values.take(pa.array(held[a : a + 10_000], pa.int64())).combine_chunks()
                    ids = batch.column(0).take(pa.array(which[a : a + 10_000], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, *(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in got.columns)], names=arrow.names)

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return out


#: Letters of the short patterns by which longer ones are dropped, in turn; the second pass is made only where the rest fills more than one automaton.
SHORT_LETTERS = (50_000, AUTOMATON_LETTERS)


def needed_patterns(lexicon: DataFrame, names: Sequence[str] = ("kind", "label")) -> DataFrame:
    """lexicon(pattern, names...) without the rows whose pattern holds a shorter one of the same names, forward or backwards: a text that has the longer one has the shorter one too.

    For use where only the names of what a text holds are asked for, and both ways of writing count. The shortest patterns, as
    many as SHORT_LETTERS allow, make an automaton that reads the patterns themselves; nothing is shuffled.
    """
    rows = lexicon.select(*names, F.col("pattern").cast("string").alias("pattern")).where("pattern IS NOT NULL")
    for most in SHORT_LETTERS:
        sizes = rows.groupBy(F.length("pattern").alias("n")).agg(F.sum(F.octet_length("pattern")).alias("letters")).orderBy("n").collect()
        if most > SHORT_LETTERS[0] and 2 * sum(r.letters for r in sizes) <= AUTOMATON_LETTERS:
            break
        longest, letters = -1, 0
        for r in sizes:
            letters += 2 * r.letters
            if letters > most:
                break
            longest = r.n
        if longest < 0:
            continue
        held: dict[str, set] = {}
        for r in rows.where(F.length("pattern") <= longest).collect():
            for p in (r.pattern, r.pattern[::-1]):
                held.setdefault(p, set()).add(tuple(r)[:-1])
        sent = rows.sparkSession.sparkContext.broadcast(held)

        def run(batches, sent=sent):
            import ahocorasick

            every, machine = sent.value.get("", set()), ahocorasick.Automaton()
            for p, owners in sent.value.items():
                if p:
                    machine.add_word(p, (len(p), owners))
            machine.make_automaton()
            for batch in batches:
                keep = []
                for *own, pattern in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own, n = tuple(own), len(pattern)
                    hit = n > 0 and own in every
                    if not hit and len(machine):
                        hit = any(size < n and own in owners for _, (size, owners) in machine.iter(pattern))
                    keep.append(not hit)
                yield batch.filter(pa.array(keep, pa.bool_()))

        rows = shared_table(rows.mapInArrow(run, rows.schema).distinct())
    return rows


def match_aliases(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, kind, label): a pattern stands in the text, forward or reversed. Ids are unique."""
    rows = rule_rows(lexicon.select("kind", "label", "pattern").where("pattern is not null"))
    if rows is None:
        return held_patterns(docs, needed_patterns(lexicon), mirrored=True).select("doc_id", "kind", "label").distinct()
    ways = constants(sorted({(r.kind, r.label, p) for r in rows for p in (r.pattern, r.pattern[::-1])}, key=str), "kind", "label", "pattern")
    hits = F.filter(ways, lambda e: F.contains(F.col("text"), e["pattern"]))
    labels = F.array_distinct(F.transform(hits, lambda e: F.struct(e["kind"].alias("kind"), e["label"].alias("label"))))
    return docs.select("doc_id", F.explode(labels).alias("l")).select("doc_id", "l.kind", "l.label")


def classify_type(docs: DataFrame, rules: DataFrame, generic: list[str] = (), rest: str = "unclassified") -> DataFrame:
    """The first rule (by ord) whose pattern is in the title, else the first whose pattern, no generic one, is in the text."""
    rows = rule_rows(rules.select("label", "pattern", "ord").where("pattern is not null"))
    if rows is None:
        wanted = rules.select("label", "pattern", "ord")
        title = held_patterns(docs.select("doc_id", F.lower("title").alias("text")), wanted).withColumn("_place", F.lit(0))
        body = held_patterns(docs.select("doc_id", F.lower("text").alias("text")), wanted.where(~F.col("pattern").isin(list(generic)))).withColumn("_place", F.lit(1))
        best = title.union(body).groupBy("doc_id").agg(F.min_by("label", F.struct("_place", "ord")).alias("doc_type"))
        return docs.select("doc_id").join(best, "doc_id", "left").fillna(rest, ["doc_type"])
    order = sorted(rows, key=lambda r: r.ord)
    first = lambda c, rs: F.get(F.filter(constants([(r.label, r.pattern) for r in rs], "label", "pattern"), lambda e: F.contains(c, e["pattern"])), F.lit(0))["label"]
    low = docs.select("doc_id", F.lower("title").alias("_title"), F.lower("text").alias("_text"))
    return low.select("doc_id", F.coalesce(first(F.col("_title"), order), first(F.col("_text"), [r for r in order if r.pattern not in generic]), F.lit(rest)).alias("doc_type"))


def classify_segments(docs: DataFrame, rules: DataFrame, most: int = 8) -> DataFrame:
    """(doc_id, label, keywords): the keywords of each class that a text holds. Ids are unique."""
    rows = rule_rows(rules.select("label", "pattern").where("pattern is not null"))
    if rows is None:
        hits = held_patterns(docs.select("doc_id", F.lower("text").alias("text")), rules.select("label", "pattern"))
        return hits.groupBy("doc_id", "label").agg(F.slice(F.array_sort(F.collect_set("pattern")), 1, most).alias("keywords"))
    words: dict[str, set[str]] = {}
    for r in rows:
        words.setdefault(r.label, set()).add(r.pattern)
    held = lambda ps: F.slice(F.filter(F.array(*[F.lit(p) for p in sorted(ps)]), lambda p: F.contains(F.col("low"), p)), 1, most)
    classes = F.array(*[F.struct(F.lit(label).alias("label"), held(ps).alias("keywords")) for label, ps in words.items()])
    if not words:
        classes = F.array().cast("array<struct<label:string,keywords:array<string>>>")
    low = docs.select("doc_id", F.lower("text").alias("low"))
    return low.select("doc_id", F.explode(classes).alias("c")).where(F.size("c.keywords") > 0).select("doc_id", "c.label", "c.keywords")


def importance(docs: DataFrame, key_types: list[str]) -> DataFrame:
    """Points for key types, known deeds, case numbers, amounts, parties (three at most) and readability."""
    points = (
        F.when(F.col("doc_type").isin(key_types), 3).otherwise(0)
        + F.when(F.col("n_deeds") > 0, 3).otherwise(0) + F.when(F.col("n_cases") > 0, 1).otherwise(0)
        + F.when(F.col("n_amounts") > 0, 1).otherwise(0) + F.least(F.col("n_parties"), F.lit(3)) + F.when(F.col("readable"), 1).otherwise(0)
    )
    return docs.withColumn("importance", points)


def entity_frequency(entity: DataFrame, k: int = 50) -> DataFrame:
    """Documents per value, the k most frequent of each kind."""
    df = entity.groupBy("kind", "value").agg(F.countDistinct("doc_id").alias("docs"))
    return df.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("docs"), "value"))).where(F.col("n") <= k).drop("n")


def lines_after(lines: Column, at: Column, reach: int = 30) -> Column:
    """The lines of an array that follow place `at` (from 0), fewer than `reach` of them."""
    return F.slice(lines, at + 2, F.lit(reach - 1))


def capture_after(
    docs: DataFrame, anchors: Sequence[tuple[str, str]], reach: int = 30, most: int = 14, shortest: int = 12, longest: int = 500, stop: int = 600, section: str | None = None, alike: int = 50, cap: int = 80
) -> DataFrame:
    """(doc_id, place, label, line_no, line): what follows anchor lines of docs(doc_id, text); anchors are (pattern, label).

    After each line that matches an anchor, up to `most` stripped lines longer than `shortest` and shorter than `longest`
    characters are taken from the next reach - 1, until a blank line once one is taken, a line of more than `stop` characters, or
    one that starts with `section` once more than six are taken. A line is cut at 480 characters; of a document's lines that agree
    in their first `alike` characters (white space squeezed) the first stays, and the first `cap` of those are given, in the order
    of anchor lines, anchors and lines. Each text's lines are split once, and every anchor folds over the lines in its reach
    inside the row; only captured lines are shuffled. Ids are unique; null texts have no lines.
    """
    ls = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), strip)
    kind = "array<struct<line_no:int,line:string>>"

    def step(s: Column, x: Column) -> Column:
        size, taken = F.length(x["line"]), F.size(s["out"])
        ends = ((size == 0) & (taken > 0)) | (size > stop) | (taken >= most)
        if section:
            ends = ends | (x["line"].rlike(f"^(?:{section})") & (taken > 6))
        ends = s["ended"] | ends
        take = ~ends & (size > shortest) & (size < longest)
        return F.struct(ends.alias("ended"), F.when(take, F.concat(s["out"], F.array(F.struct(x["line_no"].alias("line_no"), F.substring(x["line"], 1, 480).alias("line"))))).otherwise(s["out"]).alias("out"))

    def captured(place: Column) -> Column:
        rows = F.transform(lines_after(F.col("_ls"), place, reach), lambda x, i: F.struct((place + i + 2).alias("line_no"), x.alias("line")))
        return F.aggregate(rows, F.struct(F.lit(False).alias("ended"), F.array().cast(kind).alias("out")), step, lambda s: s["out"])

    split = docs.select("doc_id", ls.alias("_ls"))

    def places_of(k: int, pattern: str) -> Column:
        at = F.filter(F.transform("_ls", lambda x, i: F.when(x.rlike(pattern), i)), lambda i: i.isNotNull())
        return F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(k).alias("anchor")))

    places = F.flatten(F.array(*[places_of(k, pattern) for k, (pattern, _) in enumerate(anchors)]))
    each = split.select("doc_id", "_ls", places.alias("_places")).where(F.size("_places") > 0)
    taken = each.select("doc_id", F.explode(F.flatten(F.transform("_places", lambda p: F.transform(captured(p["at"]), lambda c: F.struct(p["at"].alias("at"), p["anchor"].alias("anchor"), c["line_no"].alias("line_no"), c["line"].alias("line")))))).alias("c"))
    key = F.substring(F.regexp_replace("c.line", r"\s+", " "), 1, alike)
    once = taken.groupBy("doc_id", key.alias("_key")).agg(F.min("c").alias("c"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("c"))
    label = F.element_at(F.array(*[F.lit(label) for _, label in anchors]), F.col("c.anchor") + 1)
    return once.withColumn("place", place).where(F.col("place") <= cap).select("doc_id", "place", label.alias("label"), "c.line_no", "c.line")
