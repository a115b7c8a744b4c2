"""Column helpers for text: digits, normal forms, stems, dates, grades (scalar expressions)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Digits, marks and letters that the normal forms unify.
ARABIC_DIGITS, PERSIAN_DIGITS = "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹"
MARKS = "ًٌٍَُِّْٰـ"
ALEF = "أإآٱ"
BIDI = "​‌‍‎‏‪‫‬‭‮⁦⁧⁨⁩﻿"
PREFIXES = ("وال", "بال", "كال", "فال", "لل", "ال", "و")
SUFFIXES = ("ها", "ات", "ان", "ون", "ين", "يه", "ه", "ي")
#: Letters that look alike, and the letters that stand for them.
LOOK_ALIKES, LOOKED_LIKE = "ھہۀۃیۍک", "هههةييك"
TATWEEL = "ـ"
#: A letter, digit or mark of Arabic script; texts without one are spared what the forms and stems do to these alone.
ARABIC = r"[\u0600-\u06FF]"


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility form; Spark has no function for it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def ascii_digits(c: Column) -> Column:
    return F.translate(c, ARABIC_DIGITS + PERSIAN_DIGITS, "0123456789" * 2)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def bound(value: Column, use) -> Column:
    """use(value) with value computed once for each row, however often `use` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without blanks, tabs and line ends at either end."""
    return F.trim(c, F.lit(" \t\r\n\x0b\f"))


def search_form(c: Column) -> Column:
    """No marks, one form of each letter, lower case; the length changes only by the marks."""
    return F.lower(F.when(c.rlike(ARABIC), F.translate(ascii_digits(c), ALEF + "ىةؤئ" + MARKS, "اااا" + "يهوي")).otherwise(c))


def audit_form(c: Column, compatibility: bool = False) -> Column:
    """The normal form for matching: compatibility letters (Python hop, on request), digits, marks, letters, single spaces."""
    base = nfkc(c) if compatibility else c
    return squeeze(F.translate(ascii_digits(base), ALEF + "ىةؤئ" + MARKS, "اااا" + "يهوي"))


def line_form(c: Column) -> Column:
    """The form in which lines are compared: letters and digits only, lower case, single spaces."""
    return squeeze(F.lower(F.regexp_replace(F.translate(c, MARKS, ""), r"[^\p{L}\p{N}]+", " ")))


def without_controls(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), BIDI, "")


def clean_letters(c: Column) -> Column:
    """Drop direction marks, map look-alike letters, Persian to Arabic-Indic digits."""
    return F.translate(c, LOOK_ALIKES + PERSIAN_DIGITS + BIDI, LOOKED_LIKE + ARABIC_DIGITS)


def light_stem(c: Column) -> Column:
    """Take off one prefix and one suffix, each only if two letters stay; what has no Arabic letter is its own stem."""
    bare = F.regexp_replace(c, rf"(?s)\A(?:{'|'.join(PREFIXES)})(?=..)", "")
    return F.when(c.rlike(ARABIC), F.regexp_replace(bare, rf"(?s)(?<=..)(?:{'|'.join(SUFFIXES)})\z", "")).otherwise(c)


def hijri_key(c: Column) -> Column:
    """yyyymmdd of a Hijri date in either order; null if there is none."""
    d = ascii_digits(c)
    first = r"(1[34]\d{2})\s*[/-]\s*(\d{1,2})\s*[/-]\s*(\d{1,2})"
    last = r"(\d{1,2})\s*[/-]\s*(\d{1,2})\s*[/-]\s*(1[34]\d{2})"
    g = lambda p, i: F.try_to_number(F.regexp_extract(d, p, i), F.lit("9999")).cast("int")
    return F.coalesce(g(first, 1) * 10000 + g(first, 2) * 100 + g(first, 3), g(last, 3) * 10000 + g(last, 2) * 100 + g(last, 1))


def gregorian_key(c: Column) -> Column:
    """yyyymmdd of a Gregorian date in either order; null if there is none."""
    d = ascii_digits(c)
    first, last = r"((?:19|20)\d{2})\s*[/-]\s*(\d{1,2})\s*[/-]\s*(\d{1,2})", r"(\d{1,2})\s*[/-]\s*(\d{1,2})\s*[/-]\s*((?:19|20)\d{2})"
    g = lambda p, i: F.try_to_number(F.regexp_extract(d, p, i), F.lit("9999")).cast("int")
    return F.coalesce(g(first, 1) * 10000 + g(first, 2) * 100 + g(first, 3), g(last, 3) * 10000 + g(last, 2) * 100 + g(last, 1))


def hijri_to_date(key: Column) -> Column:
    """The civil tabular calendar, by Julian day."""
    y, m, d = F.floor(key / 10000), F.floor(key / 100) % 100, key % 100
    jd = d + F.ceil(29.5 * (m - 1)) + 354 * (y - 1) + F.floor((3 + 11 * y) / 30) + 1948439
    return F.date_add(F.lit("1970-01-01").cast("date"), (jd - 2440588).cast("int"))


def date_to_hijri(c: Column) -> Column:
    """yyyymmdd in the civil tabular calendar: the year from the 30-year cycle of 10,631 days, then months of 30 and 29 days in turn."""
    day = F.date_diff(c, F.lit("1970-01-01").cast("date")) + 2440588 - 1948440
    y = F.floor((30 * day + 10646) / 10631)
    into = day - 354 * (y - 1) - F.floor((3 + 11 * y) / 30)
    m = F.least(F.lit(12), F.floor(into / 29.5) + 1)
    return (y * 10000 + m * 100 + into - F.ceil(29.5 * (m - 1)) + 1).cast("int")


def file_id(url: Column) -> Column:
    """The id in .../d/<id> or ?id=<id>; null if there is none."""
    return F.nullif(F.coalesce(F.nullif(F.regexp_extract(url, r"/d/([A-Za-z0-9_-]+)", 1), F.lit("")), F.regexp_extract(url, r"[?&]id=([A-Za-z0-9_-]+)", 1)), F.lit(""))


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def grade(c: Column, bands=((80, "excellent"), (60, "good"), (40, "fair"), (20, "weak")), rest: str = "poor") -> Column:
    """The first band whose floor the value reaches."""
    out = F.lit(rest)
    for floor, name in sorted(bands):
        out = F.when(c >= floor, name).otherwise(out)
    return out


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def tokens(c: Column, least: int = 2) -> Column:
    """Runs of letters and digits in search form, of at least so many characters."""
    return F.regexp_extract_all(search_form(c), F.lit(rf"[\p{{L}}\p{{N}}]{{{least},}}"), F.lit(0))


def plausible_phrase(line: Column, script: str = "؀-ۿ") -> Column:
    """Whether a line is a real phrase: two words or more with two letters of the script each, and at least 55 % of its characters but blanks are of the script. A null line is none."""
    words = F.filter(F.split(line, r"\s+"), lambda w: F.regexp_count(w, F.lit(f"[{script}]")) >= 2)
    body = F.length(F.replace(line, F.lit(" "), F.lit("")))
    return F.coalesce((F.size(words) >= 2) & (100 * F.regexp_count(line, F.lit(f"[{script}]")) >= 55 * body), F.lit(False))


def garbled_line(line: Column, letters: str = "ء-ي") -> Column:
    """Whether a line is scraps of recognition: no run of letters, four letters or fewer in all, or 60 % of the runs of one or two letters. A null line is."""
    runs = F.regexp_extract_all(line, F.lit(f"([{letters}]+)"), F.lit(1))
    short = F.size(F.filter(runs, lambda r: F.length(r) <= 2))
    return F.coalesce((F.size(runs) == 0) | (F.length(F.array_join(runs, "")) <= 4) | (5 * short >= 3 * F.size(runs)), F.lit(True))
