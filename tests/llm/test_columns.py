"""What passes through the operators beside the text: nulls beside large ids, times, decimals, arrays and clashing names."""

import datetime
import decimal
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import bpe, decontaminate, licenses, passages, recurrent_lm, simhash, token_counts, toxicity, url_filter, webp

P = pytest.importorskip("public_tokenizers")
BIG = 2**53 + 1
SCHEMA = (
    "doc_id long, text string, at timestamp, price decimal(20,3), parts array<long>, row string, spans int, gone string, fp string, media string, hits int, score string, id long, n_tokens string, tail string, shorter int"
)


def frame(spark):
    at = datetime.datetime(2020, 1, 2, 3, 4, 5, 678)
    rows = [(BIG, "some words here", at, decimal.Decimal("1.250"), [BIG, None]), (None, "other words", None, None, None), (BIG, "some words here", at, None, []), (3, None, at, None, [1]), (4, "", None, None, None)]
    return spark.createDataFrame([(*r, "r", 1, "g", "f", "m", 2, "s", 9, "n", "t", 5) for r in rows], SCHEMA)


def passed(spark, out, replaced=()):
    cols = [c for c in ("doc_id", "at", "price", "parts", "row", "spans", "gone", "fp", "media", "hits", "id", "tail", "shorter") if c not in replaced]
    assert set(cols) <= set(out.columns) and len(out.columns) == len(set(out.columns))
    key = lambda df: sorted(map(repr, df.select(cols).collect()))
    assert key(out) == key(frame(spark))


def labels(spark):
    return spark.createDataFrame([(BIG, 1), (3, 0), (None, 1)], "doc_id long, toxic int")


def test_one_by_one(spark):
    docs = frame(spark)
    passed(spark, webp.media_columns(docs), {"media"})
    passed(spark, bpe.bpe_encode_decode(docs, bpe.default_path()))
    passed(spark, token_counts.token_counts(docs, P.path("piece_bpe_32k.model")))
    passed(spark, toxicity.toxicity(docs, labels(spark)), {"hits"})
    passed(spark, simhash.near_duplicates(docs), {"fp"})
    passed(spark, recurrent_lm.lm_scores(docs, docs.where("doc_id is not null")))
    for f in (webp.media_columns, lambda d: toxicity.toxicity(d, labels(spark)), lambda d: token_counts.token_counts(d, P.path("piece_bpe_32k.model"))):
        assert f(docs.limit(0)).count() == 0


def test_pairs(spark):
    docs = frame(spark)
    words = [f"w{random.Random(1).randrange(9000) + i}" for i in range(60)]
    more = docs.where("doc_id = 3").withColumn("text", F.lit(" ".join(words)))
    both = docs.union(more).union(more.withColumn("doc_id", F.lit(BIG + 2)))
    found = passages.repeated_passages(both)
    assert [(r.doc_id, r.source_doc_id) for r in found.collect()] == [(BIG + 2, 3)]
    kept = passages.cut_passages(both, found)
    assert kept.schema == both.schema
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, both.where(f"coalesce(doc_id, 0) <> {BIG + 2}").collect()))
    assert sorted(map(repr, passages.cut_passages(docs, found).collect())) == sorted(map(repr, docs.collect()))
    bench = spark.createDataFrame([(7, " ".join(words[:30])), (None, " ".join(words[30:]))], "item_id long, text string")
    got = decontaminate.leaks(both.union(more.withColumn("doc_id", F.lit(None).cast("long"))), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d in (3, BIG + 2, None) for i in (7, None)}
    assert simhash.first_of_groups(both).schema == both.schema


def test_pre_token_patterns_agree():
    rng = random.Random(5)
    pool = [chr(c) for c in range(0x700) if not 0xD800 <= c < 0xE000 and not bpe._unlike(chr(c))] + list("  \n\t''sdm _09—“”  ")
    find = bpe.regex.compile(bpe.PRE_TOKEN).findall
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(60)))
        assert bpe._find(text) == find(text)
    for text in ("x²y", "a\x1cb", "ⅷ", "中文"):
        assert bpe._unlike(text)


def test_licences_and_urls_keep_all_columns(spark):
    names = ["dir", "dir_licence", "row", "up", "o", "notice", "is_licence", "licence", "entropy", "suffix", "suffix_rate", "url_length", "hyphens", "label", "_by_rule", "host"]
    rows = [(None, "a/LICENSE", "Released under the MIT License.", "http://a.net/es/x"), (BIG, "a/b/c/d.txt", None, None), (BIG, "a/b/c/d.txt", "", "no url"), (3, None, "plain", "http://b.org/q?x=1"), (3, None, "plain", "http://b.com/q")]
    df = spark.createDataFrame([(*r, *names) for r in rows], "doc_id long, path string, text string, url string, " + ", ".join(f"{n} string" for n in names))
    scanned = licenses.license_scan(df)
    assert sorted((repr(r.doc_id), r.dir, r.dir_licence, r.row, r.licence, r.licence_from) for r in scanned.collect()) == sorted(
        [("None", *names[:3], "MIT", "a/LICENSE"), *[(repr(BIG), *names[:3], "MIT", "a")] * 2, *[("3", *names[:3], None, None)] * 2]
    )
    judged = url_filter.judge_urls(df, trees=2)
    got = judged.collect()
    assert len(got) == 5 and all([r[n] for n in names if n not in ("host", "path")] == [n for n in names if n not in ("host", "path")] for r in got)
    assert {(r.url, r.host, r.rule) for r in got} == {("http://a.net/es/x", "a.net", "net/es/"), (None, "", None), ("no url", "", None), ("http://b.org/q?x=1", "b.org", None), ("http://b.com/q", "b.com", "com/")}
    for f, d in ((licenses.license_scan, df), (url_filter.judge_urls, df)):
        assert f(d.limit(0)).count() == 0


def test_whole_licence_files(spark):
    bsd = "Copyright (c) 2020, X\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n"
    third = "\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
    files = {
        "a/LICENSE": ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n", "Apache-2.0"),
        "g/COPYING": ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nEveryone is permitted to copy and distribute verbatim copies\n", "GPL-3.0"),
        "l/COPYING.LESSER": ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n", "LGPL-3.0"), "f/LICENSE": ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n", "AGPL-3.0"),
        "b2/LICENSE": (bsd, "BSD-2-Clause"), "b3/LICENSE": (bsd + third, "BSD-3-Clause"),
    }
    df = spark.createDataFrame([(p, t) for p, (t, _) in files.items()] + [("b2/deep/er/x.c", "int x;"), ("b2/deep/y.c", None)], "path string, text string")
    got = {r.path: (r.licence, r.licence_from) for r in licenses.license_scan(df).collect()}
    assert got == {p: (name, p) for p, (_, name) in files.items()} | {"b2/deep/er/x.c": ("BSD-2-Clause", "b2"), "b2/deep/y.c": ("BSD-2-Clause", "b2")}
