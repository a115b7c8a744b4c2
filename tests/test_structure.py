"""Folds over lines, running totals, streams with a watermark."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import extract, lines, package, pairs, registers, repair, search
from scriptorium.streaming import incremental, versions


def paragraphs_of(text, heading, least=40):
    import re

    out, held, blanks, before = [], [], 0, None

    def close():
        if held:
            out.append(("para", " ".join(held)))
            held.clear()

    for raw in (text or "").split("\n"):
        line = raw.strip(" \t\r\n\x0b\f")
        if not line:
            blanks += 1
            if blanks == 2:
                close()
            continue
        blanks = 0
        form = "".join(ch if ch.isalnum() else " " for ch in line).lower().split()
        if not form or form == before:
            continue
        before = form
        if re.match(heading, line):
            close()
            out.append(("heading", line))
            continue
        held.append(line)
        if line[-1] in ".؟!?" and len(" ".join(held)) > least:
            close()
    close()
    return out


def noise(seed, n):
    rng = random.Random(seed)
    return "\n".join(rng.choice(["", "", " ", "TITLE", "short.", "a somewhat longer line", "the end of a sentence of some length here.", "***", "same", "same", "نص؟", "x" * 90]) for _ in range(n))


def test_paragraphs_by_hand(spark, monkeypatch):
    texts = [noise(i, i * 3) for i in range(40)] + [None, "", "\n\n\n", "TITLE", "TITLE\nTITLE\nx", noise(99, 3000)]
    monkeypatch.setattr(repair, "FOLD_LINES", 7)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in repair.rebuild_paragraphs(df, "[A-Z]{3,}$").orderBy("doc_id", "para_no").collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.text))
    assert got == {i: p for i, t in enumerate(texts) if (p := paragraphs_of(t, "[A-Z]{3,}$"))}
    plan = repair.rebuild_paragraphs(df, "X")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan.split("Scan")[0]


def captured(text, anchors, cap=80):
    import re

    ls, rows = [x.strip(" \t\r\n\x0b\f") for x in (text or "").split("\n")], []
    for i, line in enumerate(ls):
        for pattern, label in anchors:
            if not re.search(pattern, line):
                continue
            taken = 0
            for j in range(i + 1, min(i + 30, len(ls))):
                s = ls[j]
                if not s:
                    if taken:
                        break
                    continue
                if len(s) > 600 or taken >= 14 or (re.match("[0-9]+[.)]", s) and taken > 6):
                    break
                if 12 < len(s) < 500:
                    rows.append((label, j + 1, s[:480]))
                    taken += 1
    seen, out = set(), []
    for label, no, s in rows:
        key = re.sub(r"\s+", " ", s)[:50]
        if key not in seen:
            seen.add(key)
            out.append((label, no, s))
    return out[:cap]


def test_capture_by_hand(spark):
    rng = random.Random(8)
    kinds = ["", "short", "GROUNDS of it", "also GROUNDS and REASONS", "1) a numbered line of its own", "y" * 490, "z" * 700, "w" * 550]
    texts = ["\n".join(rng.choice(kinds) if rng.random() < 0.3 else f"line {rng.randrange(10**6)} " + "filler " * 8 for _ in range(n)) for n in (3, 10, 50, 400)] + [None, "", "GROUNDS"]
    anchors = [("GROUNDS", "grounds"), ("REASONS", "reasons")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in extract.capture_after(df, anchors, section="[0-9]+[.)]").orderBy("doc_id", "place").collect():
        got.setdefault(r.doc_id, []).append((r.label, r.line_no, r.line))
    assert got == {i: c for i, t in enumerate(texts) if (c := captured(t, anchors))}
    assert len(got[3]) == 80


@pytest.mark.parametrize("rows_a_range", [1, 7, 10**6])
def test_running_total_in_ranges(spark, rows_a_range):
    rng = random.Random(3)
    keys = rng.sample(range(1000), 60)
    df = spark.createDataFrame([(k, k % 7) for k in keys], "k long, n long").repartition(3)
    got = {r.k: r.total for r in registers.running_total(df, "k", F.col("n"), "total", rows_a_range).collect()}
    assert got == {k: sum(j % 7 for j in keys if j <= k) for k in keys}
    assert registers.running_total(df.limit(0), "k", F.col("n"), "total").count() == 0


def test_first_n(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 9)], "g string, n long")
    assert sorted(map(tuple, registers.first_n(df, ["g"], [F.desc("n")], 2).collect())) == [("a", 2), ("a", 3), ("b", 9)]


def test_dedupe_over_watermark(spark, tmp_path):
    schema = "id string, at timestamp, v long"

    def batch(*rows):
        spark.createDataFrame(rows, "id string, at string, v long").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        return incremental.dedupe_stream(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/log", "id", "at", "1 hour", files_a_batch=1)

    batch(("a", "2024-01-01 00:00:00", 1), ("b", "2024-01-01 00:10:00", 2), (None, "2024-01-01 00:10:00", 3), ("x", None, 4))
    batch(("a", "2024-01-01 00:30:00", 5), ("c", "2024-01-01 09:00:00", 6))
    batch(("b", "2024-01-01 00:20:00", 7), ("d", "2024-01-01 09:30:00", 8), ("c", "2024-01-01 09:10:00", 9))
    batch(("a", "2024-01-01 09:40:00", 10))
    query = run()
    rows = lambda: sorted(r.v for r in spark.read.parquet(f"{tmp_path}/out").collect())
    # 5 and 9 repeat a key in time, 7 is late; a comes again hours later, when its state is gone
    assert rows() == [1, 2, 3, 6, 8, 10]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3
    run()
    assert rows() == [1, 2, 3, 6, 8, 10]


def brute_groups(sets, threshold):
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold - 1e-9]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {i: label[i] for i in {x for e in links for x in e}}


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_set_groups_by_hand(spark, threshold):
    rng = random.Random(7)
    sets = {i: frozenset(rng.sample(range(25), rng.randrange(1, 9))) for i in range(150)}
    sets |= {1000 + i: frozenset(range(30 + i, 42 + i)) for i in range(12)}  # a chain whose ends are far apart
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()] + [(5000, [])], "id long, items array<long>")
    assert {r.id: r.group for r in pairs.set_groups(df, threshold).collect()} == brute_groups(sets, threshold)


def test_cluster_has_one_row_for_each_text(spark):
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join([*base[:40], f"own{i}", *base[41:]]) for i in range(600)] + ["copy " * 9] * 5 + [None, "", "short one"]
    got = pairs.near_duplicate_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.group_id) for r in got) == [(i, 0) for i in range(600)] + [(i, 600) for i in range(600, 605)]
    titles = spark.createDataFrame([(1, "a b c d"), (2, "A b c e"), (3, "x y"), (4, "x Y"), (5, None), (6, "alone")], "doc_id long, title string")
    assert sorted(map(tuple, pairs.similar_title_groups(titles, 0.6).collect())) == [(1, 1), (2, 1), (3, 3), (4, 3)]


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.75])
def test_title_groups_by_hand(spark, threshold):
    rng = random.Random(11)
    words = [rng.sample(range(18), rng.randrange(1, 13)) for _ in range(200)]  # shorter and longer than SMALL
    df = spark.createDataFrame([(i, " ".join(f"W{w}" for w in ws)) for i, ws in enumerate(words)] + [(900, " "), (901, None)], "doc_id long, title string")
    by_title = {}
    for i, ws in enumerate(words):
        by_title.setdefault(" ".join(map(str, ws)), []).append(i)
    want = brute_groups({ids[0]: frozenset(words[ids[0]]) for ids in by_title.values()}, threshold)
    want = {i: want.get(ids[0], ids[0]) for ids in by_title.values() for i in ids if len(ids) > 1 or ids[0] in want}
    assert {r.doc_id: r.group_id for r in pairs.similar_title_groups(df, threshold).collect()} == want


def test_short_titles_are_not_compared_in_pairs(spark, monkeypatch):
    monkeypatch.setattr(pairs, "_agreeing", None)
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.col("id") % 10, F.lit("-"), F.floor(F.col("id") / 10) % 20 + 100, F.floor(F.col("id") / 200) + 1000).alias("title"))
    assert {r.group_id for r in pairs.similar_title_groups(df, 0.6).collect()} == {0}


@pytest.mark.parametrize("letters", [30, 10**6])
def test_long_lexicons_by_hand(spark, monkeypatch, letters):
    monkeypatch.setattr(extract, "AUTOMATON_LETTERS", letters)
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abم") for _ in range(n))
    texts = [(i, word(rng.randrange(30))) for i in range(40)] + [(None, "ab"), (99, None)]
    rules = [("k", f"l{i % 7}", word(rng.randrange(5)), i) for i in range(60)] + [("k", "none", None, 99), ("k", "twice", "ab", 5), ("k", "twice", "ab", 5)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    lexicon = spark.createDataFrame(rules, "kind string, label string, pattern string, ord int")
    got = sorted(map(repr, map(tuple, extract.held_patterns(df, lexicon).collect())))
    assert got == sorted(repr((d, *r)) for d, t in texts for r in rules if t is not None and r[2] is not None and r[2] in t)
    monkeypatch.setattr(extract, "RULE_ROWS", 3)
    found = {tuple(r) for r in extract.match_aliases(df, lexicon).collect()}
    assert found == {(d, r[0], r[1]) for d, t in texts for r in rules if t is not None and r[2] is not None and (r[2] in t or r[2] in t[::-1])}
    plan = extract.match_aliases(df, lexicon)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan
    titled = df.where("doc_id is not null").withColumn("title", F.reverse("text"))
    best = {r.doc_id: r.doc_type for r in extract.classify_type(titled, lexicon, generic=["b"]).collect()}
    for d, t in texts:
        if d is not None:
            hits = [(place, o, label) for place, body in ((0, t and t[::-1]), (1, t)) for _, label, p, o in rules if body is not None and p is not None and p in body and not (place and p == "b")]
            assert best[d] in ({label for *k, label in hits if k == list(min(hits)[:2])} or {"unclassified"})
    assert extract.held_patterns(df, lexicon.limit(0)).count() == 0


def test_versions(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = [(1, "old", 50.0, False, None), (2, "old", 70.0, False, None), (3, "old", 50.0, True, "first"), (4, None, 10.0, None, None), (5, "old", 50.0, False, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality double, replaced boolean, old_text string")
    new = spark.createDataFrame([(1, "new", 59.0), (1, "b", 60.0), (1, "a", 60.0), (2, "new", 99.0), (3, "new", 99.0), (4, "new", 30.0), (5, None, 99.0), (5, "new", 57.0)], "doc_id long, text string, quality double")
    with pytest.raises(ValueError):
        versions.read_version(spark, path)
    assert versions.write_version(docs, path, "load") == 1
    change = lambda d: versions.with_best_texts(d, new).drop("decision")
    assert [versions.update_version(spark, path, change, "better") for _ in range(2)] == [2, 2]
    got = {r.doc_id: (r.text, r.quality, bool(r.replaced), r.old_text) for r in versions.read_version(spark, path).collect()}
    assert got == {1: ("a", 60.0, True, "old"), 2: ("old", 70.0, False, None), 3: ("old", 50.0, True, "first"), 4: ("new", 30.0, True, None), 5: ("old", 50.0, False, None)}
    assert sorted(map(repr, versions.read_version(spark, path, 1).collect())) == sorted(map(repr, docs.collect()))
    with pytest.raises(versions.VersionConflict):
        versions.write_version(docs, path, "late", parent=1)
    calls = []

    def slow(d):
        if not calls:
            versions.write_version(d.limit(1), path, "quick")
        calls.append(d.count())
        return d

    assert versions.update_version(spark, path, slow, "slow") == 4 and calls == [5, 1]
    assert {(r.version, r.parent, r.run) for r in versions.versions(spark, path).collect()} == {(1, None, "load"), (2, 1, "better"), (3, 2, "quick"), (4, 3, "slow")}


def test_index_in_batches_equals_one_from_scratch(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["الكتاب", "كتاب", "red", "blue", "green", "x"]) for _ in range(rng.randrange(12))) for _ in range(40)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    key = lambda rows: sorted((r.doc_id, round(r.score, 9)) for r in rows.collect())
    search.extend_index(df.where("doc_id < 15"), f"{tmp_path}/a", 1)
    search.extend_index(df.where("doc_id < 30"), f"{tmp_path}/a", 2)
    search.extend_index(df, f"{tmp_path}/a", 3)
    search.extend_index(df, f"{tmp_path}/a", 3)
    search.extend_index(df, f"{tmp_path}/b", 1)
    for query in (["كتاب", "red"], ["blue"], ["absent"], []):
        want = key(search.bm25(search.postings(df, stem=True), [w for w in query]))
        assert key(search.search_index(spark, f"{tmp_path}/a", query)) == key(search.search_index(spark, f"{tmp_path}/b", query)) == want
    stats = {r.term: r.df for r in search.term_stats(spark, f"{tmp_path}/a", ["red", "blue"]).collect()}
    assert stats == {w: sum(w in (t or "").split() for t in texts) for w in ("red", "blue")}
    plan = search.search_index(spark, f"{tmp_path}/a", ["red"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "").replace("(bucket", "[bucket") or "bucket#" in plan.split("PartitionFilters")[1][:200]


def test_occurrences_by_hand(spark, monkeypatch):
    monkeypatch.setattr(package, "FOLD_HITS", 3)
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "b", "aba", "A", " ", "كت", "ُ", "\x01", "🙂"]) for _ in range(rng.randrange(60))) for _ in range(40)] + [None, "", "ab" * 50]
    terms = ["ab", "aba", "ba b", "كتك", "bb"]
    plain = lambda t: [(i, c.lower()) for i, c in enumerate(t) if c != "ُ"]
    want = {}
    for d, t in enumerate(texts):
        letters, spans = plain(t or ""), []
        for term in terms:
            free = 0
            for k in range(len(letters) - len(term) + 1):
                if k >= free and "".join(c for _, c in letters[k : k + len(term)]) == term:
                    free = k + len(term)
                    at, end = letters[k][0], letters[k + len(term) - 1][0] + 1
                    while end < len(t) and t[end] == "ُ":
                        end += 1
                    spans.append((at, end))
        merged = []
        for s, e in sorted(spans):
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        want |= {d: [tuple(m) for m in merged]} if merged else {}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in package.highlights(df, terms).orderBy("doc_id", "start_pos").collect():
        got.setdefault(r.doc_id, []).append((r.start_pos, r.end_pos))
    assert got == want
    assert package.highlights(df, []).count() == 0
    plan = lines.kwic(df, terms)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
