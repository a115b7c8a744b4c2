"""Duplicates, similarity joins and reconciliation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import bound
from scriptorium.plans.session import shared_table


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, first_id, copies): documents with equal trimmed text; the smallest id is the first."""
    keyed = docs.select("doc_id", F.sha2(F.trim("text"), 256).alias("h"))
    groups = keyed.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    return keyed.join(groups, "h").select("doc_id", "first_id", "copies")


def same_size_groups(docs: DataFrame, size: str) -> DataFrame:
    return docs.where(F.col(size) > 0).groupBy(size).agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("docs > 1")


def set_join(left: DataFrame, right: DataFrame, id_col: str, items: Column, threshold: float, itself: bool = False) -> DataFrame:
    """Pairs (a, b, similarity) of sets with Jaccard at or above the threshold, exact.

    Prefix filter: items are put in order of rising frequency; two sets that reach the threshold share one of the first
    size - ceil(threshold * size) + 1 items of each, so only these are joined, and candidates are verified whole. With `itself`,
    both sides are one table and a < b.
    """
    a, b = (d.select(F.col(id_col).alias("id"), F.array_distinct(items).alias("items")).where(F.size("items") > 0) for d in (left, right))
    both = a if itself else a.union(b)
    df = both.select(F.explode("items").alias("t")).groupBy("t").agg(F.count("*").alias("df"))

    def prefix(side: DataFrame, name: str) -> DataFrame:
        ranked = side.select("id", F.size("items").alias("n"), F.explode("items").alias("t")).join(df, "t")
        w = Window.partitionBy("id").orderBy("df", "t")
        short = ranked.withColumn("i", F.row_number().over(w)).where(F.col("i") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
        return short.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), "t")

    pairs = prefix(a, "a").join(prefix(b, "b"), "t").where((F.col("n_a") >= F.col("n_b") * threshold - 1e-9) & (F.col("n_b") >= F.col("n_a") * threshold - 1e-9))
    pairs = (pairs.where("a < b") if itself else pairs).select("a", "b").distinct()
    whole = pairs.join(a.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(b.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    same = F.size(F.array_intersect("x", "y"))
    return whole.select("a", "b", (same / (F.size("x") + F.size("y") - same)).alias("similarity")).where(F.col("similarity") >= threshold - 1e-9)


def groups_of(links: DataFrame) -> DataFrame:
    """(id, group): the smallest id that links(a, b) lead to from each id that has a link to another; links go both ways and may repeat.

    Every round takes the smallest label among neighbours and then the label's own label, so rounds grow with the logarithm of a
    chain's length in most graphs; each is written and the one before read once.
    """
    both = shared_table(links.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").distinct())
    labels = shared_table(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("group")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "group"), "b").groupBy(F.col("a").alias("id")).agg(F.min("group").alias("near"))
        low = labels.join(near, "id").select("id", F.least("group", "near").alias("low"), "group")
        jump = low.join(labels.select(F.col("id").alias("low"), F.col("group").alias("then")), "low", "left")
        least = F.least("low", F.coalesce("then", "low"))
        new = shared_table(jump.select("id", least.alias("group"), (least != F.col("group")).alias("moved")))
        labels = new.select("id", "group")
        if not new.where("moved").limit(1).count():
            return labels


#: Holders from which a hashed item is put behind all others, how many such items at most, items tracked to find them, and 64-bit words of the bitmap that marks them. They decide the order alone.
OFTEN, MOST_OFTEN, TRACKED, MARKS = 64, 10_000, 200_000, 8_192
#: 64-bit words of the bitmaps by which sets are told apart before they are compared.
BITMAP = 16
#: Ids up to which they are sent to all tasks rather than the sets to the ids.
FEW = 1_000_000


def _prefix_size(n: Column, threshold: float) -> Column:
    return n - F.ceil(n * threshold - 1e-9) + 1


def _prefixes(sets: DataFrame, items: Column, threshold: float, hashed: bool) -> DataFrame:
    """(id, n, i, t): the items t of each set's prefix that other prefixes have too, their place i and the set's size n.

    The prefix filter holds for any order of items that all sets share; rare ones first makes few candidates. Words are put in
    order of their frequency. Of `hashed` items most are rare, so these are put in order inside the row, by their value, and only
    the prefixes leave it, once; what many of the prefixes hold, as a sketch of all of them tells, goes behind all others.
    """
    if not hashed:
        df = sets.select(F.explode(items).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
        ranked = sets.select("id", F.size(items).alias("n"), F.explode(items).alias("t")).join(df, "t")
        place = F.row_number().over(Window.partitionBy("id").orderBy("df", "t"))
        return ranked.withColumn("i", place).where(F.col("i") <= _prefix_size(F.col("n"), threshold)).where("df > 1").select("id", "n", "i", "t")

    def short(often: list[int]) -> DataFrame:
        ordered = F.sort_array(items)
        if often:
            marks = [0] * MARKS
            for t in often:
                marks[(t >> 6) % MARKS] |= 1 << (t & 63)
            words = F.from_json(F.lit(str([m - (1 << 64) if m >> 63 else m for m in marks])), "array<bigint>")
            marked = lambda t: F.getbit(F.get(words, F.shiftright(t, 6).bitwiseAND(F.lit(MARKS - 1)).cast("int")), t.bitwiseAND(F.lit(63)).cast("int")) == 1
            # an item that shares its mark with a frequent one goes behind too, in all sets alike
            ordered = bound(ordered, lambda x: F.concat(F.filter(x, lambda t: ~marked(t)), F.filter(x, marked)))
        heads = bound(ordered, lambda x: F.struct(F.size(x).alias("n"), F.slice(x, F.lit(1), _prefix_size(F.size(x), threshold).cast("int")).alias("head")))
        # outer, since Spark would else make the sets twice, to see which are empty
        return sets.select("id", heads.alias("x")).select("id", "x.n", F.posexplode_outer("x.head").alias("i", "t")).where("t IS NOT NULL").select("id", "n", (F.col("i") + 1).alias("i"), "t")

    most = short([]).agg(F.expr(f"approx_top_k(t, {MOST_OFTEN}, {TRACKED})").alias("most")).select(F.explode("most").alias("m"))
    often = [r.item for r in most.select("m.*").where(F.col("count") >= OFTEN).collect()]
    return short(often).withColumn("df", F.count("*").over(Window.partitionBy("t"))).where("df > 1").drop("df")


def _agreeing(sets: DataFrame, items: Column, short: DataFrame, met: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity): of met(a, n_a, i_a, b, n_b, i_b) the pairs of sets(id, ...), whose items are a column over them, that reach the threshold; short are the sets' prefixes.

    Before whole sets are compared, all that the prefixes of a pair share is counted: what else the two can share stands behind
    the last item shared, and behind the prefix of at least one of them. Then bitmaps of the sets' hashes are compared: each bit
    that only one of two sets has stands for an item that the other lacks. Sets that are in no pair after that are not sent around.
    """
    n_a, n_b = F.col("n_a"), F.col("n_b")
    need = F.ceil(threshold / (1 + threshold) * (n_a + n_b) - 1e-9)
    rest = F.least(n_a - F.col("i_a"), n_b - F.col("i_b"))
    pairs = shared_table(met.where(1 + rest >= need).select("a", "n_a", "b", "n_b").distinct())
    heads = short.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("i", "t"))).alias("h")).select("id", F.col("h.t").alias("t"), F.col("h.i").alias("i"))
    both = pairs.join(heads.select(F.col("id").alias("a"), F.col("t").alias("t_a"), F.col("i").alias("p_a")), "a").join(heads.select(F.col("id").alias("b"), F.col("t").alias("t_b"), F.col("i").alias("p_b")), "b")
    behind = lambda x, shared: F.col(f"n_{x}") - F.get(f"p_{x}", (F.array_position(f"t_{x}", F.element_at(shared, -1)) - 1).cast("int"))
    beyond = lambda n: n - _prefix_size(n, threshold)
    most = bound(F.array_intersect("t_a", "t_b"), lambda shared: F.size(shared) + F.greatest(F.least(beyond(n_a), behind("b", shared)), F.least(beyond(n_b), behind("a", shared))))
    pairs = shared_table(both.where(most >= need).select("a", "n_a", "b", "n_b"))

    def inside(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        return sets.join(F.broadcast(ids) if pairs.count() <= FEW else ids, "id", "left_semi")

    bit = F.xxhash64("t")
    word = lambda i: F.bit_or(F.when(F.shiftright(bit, 6).bitwiseAND(F.lit(BITMAP - 1)) == i, F.expr("shiftleft(1L, cast(xxhash64(t) & 63 as int))")).otherwise(F.lit(0)))
    bits = inside(pairs).select("id", F.explode_outer(items).alias("t")).groupBy("id").agg(*[word(i).alias(f"w{i}") for i in range(BITMAP)]).select("id", F.array(*[f"w{i}" for i in range(BITMAP)]).alias("w"))
    both = pairs.join(bits.select(F.col("id").alias("a"), F.col("w").alias("x")), "a").join(bits.select(F.col("id").alias("b"), F.col("w").alias("y")), "b")
    lacks = lambda x, y: sum((F.bit_count(F.col(x)[i].bitwiseAND(F.bitwise_not(F.col(y)[i]))) for i in range(BITMAP)), F.lit(0))
    pairs = shared_table(both.where(F.least(n_a - lacks("x", "y"), n_b - lacks("y", "x")) >= need).select("a", "b"))
    some = inside(pairs)
    whole = pairs.join(some.select(F.col("id").alias("a"), items.alias("x")), "a").join(some.select(F.col("id").alias("b"), items.alias("y")), "b")
    similarity = bound(F.size(F.array_intersect("x", "y")), lambda same: same / (F.size("x") + F.size("y") - same))
    return whole.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold - 1e-9).distinct()  # rows of an id may repeat


def _side(name: str) -> list[Column]:
    return [F.col(c).alias(f"{c}_{name}" if c != "id" else name) for c in ("id", "n", "i")]


def set_groups(sets: DataFrame, threshold: float, hashed: Column | None = None) -> DataFrame:
    """(id, group) of sets(id, items: array) that a chain of pairs with Jaccard at or above the threshold joins to another; exact, without all pairs of a group.

    Prefix and positional filter as in set_join. `hashed` makes the items, different hash values, from other columns of sets (see
    _prefixes); of these only prefixes are written. First each set meets only the smallest id of each of its prefix items, and what agrees is grouped; then sets meet all others of their prefix items that are
    not in their group yet, and what agrees joins the groups. Of sets that are all alike, no more than one pair for each member
    and prefix item is looked at.
    """
    items = F.col("items") if hashed is None else hashed
    if hashed is None:
        sets = shared_table(sets.select("id", F.array_distinct("items").alias("items")).where(F.size("items") > 0))
    short = shared_table(_prefixes(sets, items, threshold, hashed is not None))
    hubs = short.groupBy("t").agg(F.min(F.struct("id", "n", "i")).alias("h")).select("t", F.col("h.id").alias("a"), F.col("h.n").alias("n_a"), F.col("h.i").alias("i_a"))
    first = shared_table(_agreeing(sets, items, short, short.select("t", *_side("b")).join(hubs, "t").where("a <> b"), threshold).select("a", "b"))
    known = groups_of(first)
    named = short.join(known, "id", "left").withColumn("group", F.coalesce("group", "id"))
    one, two = named.select("t", *_side("a"), F.col("group").alias("g_a")), named.select("t", *_side("b"), F.col("group").alias("g_b"))
    second = _agreeing(sets, items, short, one.join(two, "t").where("a < b AND g_a <> g_b"), threshold).select("a", "b")
    return groups_of(first.union(second))


#: Items of the largest set that is keyed by its subsets.
SMALL = 8


def _subsets(threshold: float) -> list[tuple[int, int, int, list[int]]]:
    """(n, low, high, places): for sets of n items, and the sizes low <= high of a pair that one of them is in, the places of each subset that two such sets must share."""
    out = []
    for n in range(1, SMALL + 1):
        for m in range(1, SMALL + 1):
            need = next((k for k in range(1, min(n, m) + 1) if k / (n + m - k) >= threshold - 1e-9), None)
            if need:
                out += [(n, min(n, m), max(n, m), list(c)) for c in combinations(range(1, n + 1), need)]
    return out


def small_set_links(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links whose chains join the same sets(id, items: sorted array of different items) of SMALL items at most as all pairs with Jaccard at or above the threshold do.

    Sets of n and m items reach the threshold if and only if they share a subset of a size that follows from n and m. Each set
    is keyed by such subsets and linked to the first under each key, so nothing is compared and rows grow with the sets alone.
    Keys of two sizes join sets only where both sizes are there.
    """
    plan = sets.sparkSession.createDataFrame(_subsets(threshold), "n int, low int, high int, places array<int>")
    keyed = sets.withColumn("n", F.size("items")).join(F.broadcast(plan), "n").select("id", "n", "low", "high", F.transform("places", lambda i: F.element_at("items", i)).alias("key"))
    heads = keyed.groupBy("low", "high", "key").agg(F.min("id").alias("b"), F.max("id").alias("last"), F.min("n").alias("least"), F.max("n").alias("most"))
    heads = heads.where("b < last AND least = low AND most = high").select("low", "high", "key", "b")
    return keyed.join(heads, ["low", "high", "key"]).where("id <> b").select(F.col("id").alias("a"), "b").distinct()


def _firsts(docs: DataFrame) -> DataFrame:
    """(id, text): each different trimmed text with its smallest doc_id. Texts stay where they are; their hashes are shuffled."""
    some = docs.where("text IS NOT NULL")
    keyed = some.select("doc_id", F.unhex(F.sha2(F.trim("text"), 256)).alias("h"))
    copies = shared_table(keyed.withColumn("first", F.min("doc_id").over(Window.partitionBy("h"))).where("doc_id <> first").select("doc_id").distinct())
    return some.join(F.broadcast(copies) if copies.count() <= FEW else copies, "doc_id", "left_anti").select(F.col("doc_id").alias("id"), F.trim("text").alias("text"))


def _shingles(k: int) -> Column:
    """The different k-word shingles of text, as hashes. They are made from the text wherever they are read, since written they take more room than it."""
    words = F.transform(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    gram = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return bound(words, lambda w: F.when(F.size(w) >= k, F.array_distinct(gram(w))).otherwise(F.array().cast("array<bigint>")))


def near_duplicate_groups(docs: DataFrame, threshold: float = 0.8, k: int = 5) -> DataFrame:
    """(doc_id, group_id): documents that a chain of texts with k-word shingles at or above the threshold, or copies, joins to others, with the smallest id of their group.

    One row for each document of docs(doc_id, text) in a group of several, however many pairs they make. Null texts are in none;
    texts of fewer than k words are grouped with their copies alone.
    """
    near = set_groups(_firsts(docs), threshold, hashed=_shingles(k))
    keyed = docs.select("doc_id", F.sha2(F.trim("text"), 256).alias("h")).where("h IS NOT NULL")
    firsts = keyed.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    named = firsts.join(near, F.col("first") == F.col("id"), "left").where("n > 1 OR group IS NOT NULL").select("h", F.coalesce("group", "first").alias("group_id"))
    return keyed.join(named, "h").select("doc_id", "group_id")


def similar_title_groups(docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(doc_id, group_id): docs(doc_id, title) whose titles a chain of word sets at or above the threshold joins to another's; equal titles (in lower case) are one, and join each other.

    Titles of up to SMALL different words are linked by subsets of their words, and only what longer ones may reach is compared.
    """
    title = F.lower("title")
    one = docs.where("title IS NOT NULL").groupBy(title.alias("t")).agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    sets = shared_table(one.select("id", F.array_sort(F.array_distinct(F.filter(F.split("t", r"\s+"), lambda w: w != ""))).alias("items")).where(F.size("items") > 0))
    links = small_set_links(sets.where(F.size("items") <= SMALL), threshold)
    if not sets.where(F.size("items") > SMALL).isEmpty():
        links = links.union(set_groups(sets.where(F.size("items") > F.lit(SMALL * threshold - 1e-9)), threshold).select("id", "group"))
    near = groups_of(links).withColumnRenamed("id", "_id")
    named = one.join(near, F.col("id") == F.col("_id"), "left").where("n > 1 OR group IS NOT NULL").select("t", F.coalesce("group", "id").alias("group_id"))
    return docs.join(named, title == F.col("t")).select("doc_id", "group_id")


def similar_titles(docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Pairs of different titles by word sets; equal titles are grouped first, so pairs are among distinct titles (least id of each)."""
    one = docs.groupBy(F.lower("title").alias("title")).agg(F.min("doc_id").alias("doc_id"))
    return set_join(one, one, "doc_id", F.filter(F.split("title", r"\s+"), lambda t: t != ""), threshold, itself=True)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, k: int = 5) -> DataFrame:
    """Pairs of distinct texts by k-word shingles; copies are represented by their smallest id (exact_duplicates has the members). near_duplicate_groups gives groups without all their pairs."""
    sets, items = _firsts(docs), _shingles(k)
    short = shared_table(_prefixes(sets, items, threshold, hashed=True))
    return _agreeing(sets, items, short, short.select("t", *_side("a")).join(short.select("t", *_side("b")), "t").where("a < b"), threshold)


def reconcile(study: DataFrame, archive: DataFrame, key: str) -> DataFrame:
    """Each key of either side with where it was found: both, study or archive."""
    a, b = study.select(key).distinct().withColumn("_a", F.lit(1)), archive.select(key).distinct().withColumn("_b", F.lit(1))
    found = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "both").when(F.col("_a").isNotNull(), "study").otherwise("archive")
    return a.join(b, key, "full_outer").select(key, found.alias("found"))


def only_new(incoming: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return incoming.join(known.select(key).distinct(), key, "left_anti")


def join_qc(docs: DataFrame, qc: DataFrame) -> DataFrame:
    return docs.join(qc, "doc_id", "left")


def join_by_file_id(candidates: DataFrame, docs: DataFrame, file_id: Column) -> DataFrame:
    return candidates.withColumn("id", file_id).join(docs, "id", "left")
