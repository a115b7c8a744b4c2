"""License scans (operator 1): sparse TF-IDF cosine of notices to templates, then nearest-ancestor inheritance by path joins."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Well-known notices and openings of licences.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0. Creative Commons Attribution ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights. CC0 1.0 Universal Public Domain Dedication."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Lines that may belong to a notice hold one of these; a notice is tried both whole (up to a blank line) and cut to so many lines.
CUE = r"(?i)licen[cs]e|copyright|copyleft|spdx|permission|redistribut|public domain|free software|creative commons|\bcc[ -]by|warrant"
NOTICE_LINES = 12
LEAST_COSINE = 0.6
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"

_cue = regex.compile(CUE).search
_licence_file = regex.compile(LICENCE_FILE).search
_terms = regex.compile(r"[\p{L}\p{N}]+(?:\.\p{N}+)*").findall


def terms_of(text: str) -> list[str]:
    """Words and word pairs in lower case; version numbers stay whole."""
    words = _terms(text.lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def notices(text: str | None, whole: bool = False) -> list[str]:
    """Candidate notices: each line with a cue alone, and each with the lines that follow it up to a blank line, whole and cut to NOTICE_LINES; with `whole`, the text too and its paragraphs two at a time."""
    if not text or not (whole or _cue(text)):
        return []
    lines, out, covered = text.split("\n"), [], -1
    if whole and text.strip():
        parts = [p for p in regex.split(r"\n[ \t\r]*\n", text) if p.strip()]
        out += [text, *(f"{a}\n{b}" for a, b in zip(parts, parts[1:]))]
    for i, line in enumerate(lines):
        if _cue(line):
            out.append(line)
            if i > covered:
                end = i + 1
                while end < len(lines) and lines[end].strip():
                    end += 1
                if end > i + 1:
                    out.append("\n".join(lines[i:end]))
                if end > i + NOTICE_LINES:
                    out.append("\n".join(lines[i : i + NOTICE_LINES]))
                covered = end - 1
    return out


def _vector(counts: Counter, idf: dict[str, float]) -> dict[str, float]:
    v = {t: (1 + math.log(n)) * idf[t] for t, n in counts.items() if t in idf}
    size = math.sqrt(math.fsum(x * x for x in v.values()))
    return {t: x / size for t, x in v.items()} if size else {}


class Templates:
    """Template vectors in an inverted list, so that only shared terms are touched."""

    def __init__(self, templates, idf: dict[str, float], other: float):
        self.names, self.idf, self.other = [n for n, _ in templates], idf, other
        self.lists: dict[str, list[tuple[int, float]]] = {}
        for i, (_, text) in enumerate(templates):
            for t, x in _vector(Counter(terms_of(text)), idf).items():
                self.lists.setdefault(t, []).append((i, x))

    def best(self, text: str) -> tuple[str | None, float]:
        """The closest template's licence and cosine; terms that no template has weigh in the text's length as words that no notice had yet."""
        counts = Counter(terms_of(text))
        weights = {t: (1 + math.log(n)) * self.idf.get(t, self.other) for t, n in counts.items()}
        size = math.sqrt(math.fsum(x * x for x in weights.values()))
        score: dict[int, float] = {}
        for t in sorted(counts):
            for i, x in self.lists.get(t, ()):
                score[i] = score.get(i, 0.0) + weights[t] * x / size
        if not score:
            return None, 0.0
        i = min(score, key=lambda k: (-round(score[k], 9), k))
        return self.names[i], min(1.0, score[i])


def license_scan(files: DataFrame, licence_file: Column | None = None, templates=TEMPLATES, least_cosine: float = LEAST_COSINE) -> DataFrame:
    """The licence of every row of files(path, text, ...).

    Adds own_licence and own_score (of the closest template, if at least least_cosine), licence and licence_from: the file's own
    (then its path), else that of the nearest directory upward that has a licence (then this directory). A directory's licence
    is that of its licence files (by default those named LICENSE, COPYING or the like): the best score, ties to the first path
    and licence. Null, empty and blank texts hold no notice. A null path inherits nothing. Rows that share a path share the best
    result found under that path. Other columns pass through, columns named like the new ones are replaced; an empty table
    gives an empty table. Document frequencies are those of all candidate notices of the input.
    """
    sc = files.sparkSession.sparkContext
    new = ["own_licence", "own_score", "licence", "licence_from"]
    columns = [c for c in files.columns if c not in new]
    # rows travel as structs, so that their columns' names meet none of the ones used here; a column may be given by `licence_file`
    declares = F.col("path").rlike(LICENCE_FILE) if licence_file is None else licence_file
    kept = files.drop(*new).select(F.struct(*columns).alias("row"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"), F.coalesce(declares, F.lit(False)).alias("is_licence"))

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, n) for p, t in zip(frame["path"], frame["text"], strict=True) for n in notices(t, p is not None and bool(_licence_file(p)))]
            yield pd.DataFrame(rows, columns=["path", "notice"])

    found = cut(kept.select("path", "text").mapInPandas(extract, "path string, notice string"))
    known = {t for _, text in templates for t in terms_of(text)}
    wanted = sc.broadcast(known)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df: Counter = Counter()
        for frame in frames:
            for n in frame["notice"]:
                df.update(wanted.value.intersection(terms_of(n)))
        yield pd.DataFrame(list(df.items()), columns=["term", "df"])

    df = {r.term: r.df for r in found.select("notice").mapInPandas(count, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}  # the templates' terms at most
    total = found.count()
    idf = {t: math.log((total + len(templates) + 1) / (df.get(t, 0) + 1)) + 1 for t in known}
    scorer = sc.broadcast(Templates(templates, idf, math.log(total + len(templates) + 1) + 1))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [scorer.value.best(n) for n in frame["notice"]]
            yield pd.DataFrame({"path": frame["path"], "own_licence": [g[0] for g in got], "own_score": [g[1] for g in got]})

    scored = found.mapInPandas(score, "path string, own_licence string, own_score double").where(F.col("own_score") >= least_cosine)
    order = F.struct(-F.round("own_score", 9), "own_licence")
    own = cut(scored.groupBy("path").agg(F.min_by(F.struct("own_licence", "own_score"), order).alias("o")).where("path is not null").select("path", "o.own_licence", "o.own_score"))

    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    named = kept.where("is_licence AND path IS NOT NULL").select("path").distinct()
    declared = own.join(named, "path", "left_semi").withColumn("dir", folder).groupBy("dir").agg(F.min_by("own_licence", F.struct(-F.round("own_score", 9), "path", "own_licence")).alias("dir_licence"))
    # every directory meets its ancestors once, not once for each of its files
    dirs = kept.where("path is not null").select(folder.alias("dir")).distinct()
    parts = F.split("dir", "/")
    up = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).select("dir", "depth", F.array_join(F.slice(F.split("dir", "/"), 1, F.col("depth")), "/").alias("up"))
    nearest = (
        up.join(declared.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by(F.struct("dir_licence", "up"), "depth").alias("n")).select("dir", "n.dir_licence", F.col("n.up").alias("from_dir"))
    )
    out = kept.withColumn("dir", folder).join(own, "path", "left").join(nearest, "dir", "left")
    return out.select(
        *[F.col("row").getField(c).alias(c) for c in columns],
        "own_licence",
        "own_score",
        F.coalesce("own_licence", "dir_licence").alias("licence"),
        F.when(F.col("own_licence").isNotNull(), F.col("path")).otherwise(F.col("from_dir")).alias("licence_from"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree at three depths: source, language, a folder for each thousand and each fifty ids, the id; of ten runs of twenty ids the first stand in the language's folder, the second in the thousand's."""
    name, place = F.concat(F.col("doc_id").cast("string"), F.lit(".txt")), F.pmod(F.floor(F.col("doc_id") / 20), F.lit(10))
    thousand, fifty = (F.floor(F.col("doc_id") / n).cast("string") for n in (1000, 50))
    below = F.when(place == 0, F.array(name)).when(place == 1, F.array(thousand, name)).otherwise(F.array(thousand, fifty, name))
    return docs.withColumn("path", F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), below))


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a notice of its own counts as a licence file of its folder, as the table has no file names."""
    files = document_paths(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return license_scan(files, licence_file=F.lit(True)).select("doc_id", "path", "own_licence", F.round("own_score", 6).alias("own_score"), "licence", "licence_from")
