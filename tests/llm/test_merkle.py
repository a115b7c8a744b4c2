"""The Merkle manifest against trees built by hand."""

import hashlib
import random

import pytest

from scriptorium.llm import merkle

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def climb(leaves, fanout):
    """Root, and for each leaf its siblings level by level."""
    proofs, level, place = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for k, p in enumerate(place):
            run = runs[p // fanout]
            proofs[k] += run[: p % fanout] + run[p % fanout + 1 :]
            place[k] = p // fanout
        level = [H(*r) for r in runs]
    return level[0], proofs


def brute(rows, fanout):
    groups = {}
    for g, k, leaf in sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(g, []).append((k, leaf))
    trees = {g: climb([x[1] for x in v], fanout) for g, v in groups.items()}
    root, tops = climb([t[0] for t in trees.values()], fanout)
    return sorted(((g, k, leaf, trees[g][0], root, "".join(proof + top)) for (g, v), top in zip(groups.items(), tops, strict=True) for (k, leaf), proof in zip(v, trees[g][1], strict=True)), key=repr)


def found(spark, rows, fanout):
    df = spark.createDataFrame(rows, "g string, k long, leaf string")
    got = merkle.manifest(df, "g", ["k", "leaf"], fanout=fanout)
    out = got.select("g", "k", "leaf", "subroot", "root", merkle.siblings(merkle.F.col("path")).alias("s"), merkle.recomputed(merkle.F.col("leaf"), merkle.F.col("path")).alias("again")).collect()
    assert all(r.again == r.root for r in out)
    return sorted((tuple(r)[:6] for r in out), key=repr)


@pytest.mark.parametrize(("fanout", "sizes"), [(2, [37, 1, 4, 5]), (3, [100]), (2, [64, 65]), (16, [17, 3, 300])])
def test_tree_by_hand(spark, fanout, sizes):
    rng = random.Random(fanout)
    rows = [(f"g{i}" if i else None, k if k else None, H(str(i), str(k))) for i, n in enumerate(sizes) for k in range(n)]
    rng.shuffle(rows)
    assert found(spark, rows, fanout) == brute(rows, fanout)


def test_edges(spark):
    assert found(spark, [("", 5, "ab")], 2) == [("", 5, "ab", "ab", "ab", "")]
    same = [("é", 1, "x")] * 3 + [("z", 1, "x"), (None, None, "y")]
    assert found(spark, same, 2) == brute(same, 2)
    odd = spark.createDataFrame([("a", 1, "h", "kept", 2.5)], "source string, doc_id long, leaf string, block string, other double")
    row = merkle.manifest(odd, "source", ["doc_id", "leaf"]).first()
    assert (row.root, row.subroot, row.path, row.other) == ("h", "h", [], 2.5)
    assert merkle.manifest(odd.limit(0), "source", ["doc_id"]).count() == 0


def test_fields(spark):
    df = spark.createDataFrame([("é", None), (None, 7)], "a string, b long")
    assert [tuple(r) for r in df.select(merkle.field(merkle.F.col("a")), merkle.field(merkle.F.col("b"))).collect()] == [("2:é", "-"), ("-", "1:7")]
