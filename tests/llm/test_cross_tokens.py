"""Alignment of two tokenizers against both libraries and a count by hand."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow.dataset as ds
import pytest

from scriptorium.llm import bpe, cross_tokens

P = pytest.importorskip("public_tokenizers")
EDGES = [None, "", " ", "a", "  two  blanks ", "<|endoftext|> <s> </s> <0x0A>\n", "x\0y", "ﬁ ① ½", "naïve “quotes” 🙂 中文\r\n\t", "▁ under", "word " * 3000, "z" * 4000, "　   é"]


def ends(parts):
    out, at = [], 0
    for p in parts:
        at += len(p)
        out.append(at)
    return out


def by_hand(texts):
    """Per text the columns after doc_id, from the libraries named in the vocabulary files' description."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = cross_tokens.default_paths()
    lib = Tokenizer.from_file(a_path)
    lib.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=b_path)
    back = {c: b for b, c in enumerate(bpe.byte_letters())}
    per, total = [], Counter()
    for t in texts:
        a = lib.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        bytes_a = [bytes(back[c] for c in lib.id_to_token(i)) for i in a]
        pieces = [sp.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        if not t or {b"".join(bytes_a), b"".join(bytes_b)} != {(" " + t).encode()}:
            per.append(([], [], [], []))
            continue
        end_a, end_b = ends(bytes_a), ends(bytes_b)
        common = sorted(set(end_a) & set(end_b))
        ends_here = lambda ids, es: [(e, i) for i, e in zip(ids, es, strict=True) if e in every]
        every, of_b = set(common), {}
        for e, y in ends_here(b, end_b):
            of_b.setdefault(e, []).append(y)
        links = [(y, x) for e, x in ends_here(a, end_a) for y in of_b[e]]
        groups = []
        place_a, place_b = 0, 0
        for e in common:
            own = []
            for ids, es, p in ((a, end_a, place_a), (b, end_b, place_b)):
                q = p
                while q < len(es) and es[q] <= e:
                    q += 1
                own.append((ids[p:q], q))
            place_a, place_b = own[0][1], own[1][1]
            groups.append(",".join(map(str, own[0][0])) + "|" + ",".join(map(str, own[1][0])))
        per.append((a, b, groups, links))
        total.update(links)
    highest = {}
    for (y, _), n in total.items():
        highest[y] = max(n, highest.get(y, 0))
    rows = []
    for a, b, groups, links in per:
        rows.append((len(a), len(b), len(groups), len(links), sum(total[k] == highest[k[0]] for k in links), sum(total[k] for k in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    return rows, total, highest


@pytest.mark.parametrize("small", [False, True])
def test_equals_libraries(spark, small):
    table = ds.dataset("/root/testdata/sf0.001/documents.parquet").to_table(columns=["text"]).column("text").to_pylist()
    texts = [*EDGES, *table, *table[:5]]
    size = {"run_tokens": 9_000, "fan_in": 3} if small else {}  # many runs, several passes
    df = spark.createDataFrame([(i, t, "own", 1.5) for i, t in enumerate(texts)], "doc_id long, text string, n_a string, origin double").repartition(3)
    got = cross_tokens.align(df, *cross_tokens.default_paths(), groups=True, **size)
    want, total, highest = by_hand(texts)
    columns = [*(f.split()[0] for f in cross_tokens.NEW.split(", "))]
    rows = {r.doc_id: r for r in got.documents.collect()}
    assert [tuple(rows[i][c] for c in columns) for i in range(len(texts))] == want
    assert all(r.origin == 1.5 and (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") == r.groups_sha256 for r in rows.values())
    pairs = {(r.b_id, r.a_id): (r["count"], r.best) for r in got.pairs().collect()}
    assert pairs == {k: (n, n == highest[k[0]]) for k, n in total.items()}


def test_empty(spark):
    df = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    paths = cross_tokens.default_paths()
    assert sorted(map(tuple, cross_tokens.align(df, *paths).documents.fillna(-1, ["doc_id"]).collect())) == [(-1, 0, 0, 0, 0, 0, 0, ""), (1, 0, 0, 0, 0, 0, 0, "")]
    got = cross_tokens.align(df.limit(0), *paths)
    assert got.documents.count() == 0 and got.pairs().count() == 0
    assert cross_tokens.align(df.select("text"), *paths).documents.count() == 2


def test_heap_merge():
    rng = random.Random(2)
    runs, total = [], Counter()
    for _ in range(20):
        own = Counter(rng.randrange(300) for _ in range(rng.randrange(200)))
        total.update(own)
        keys = np.array(sorted(own), np.uint32)
        counts = np.array([own[k] for k in sorted(own)], np.uint64)
        runs.append(iter([(keys[i : i + 7], counts[i : i + 7]) for i in range(0, len(keys), 7)]))
    got = [(int(k), int(n)) for keys, counts in cross_tokens.heap_merge(runs) for k, n in zip(keys, counts)]
    assert got == sorted(total.items())
