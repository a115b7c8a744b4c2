"""Merkle manifest of a table (operator 13).

Leaves of a group are dealt, in order, to blocks of fanout^2 leaves, and each block hashes its own subtree. Then the blocks of a
group swap roots as a butterfly does: in round r, those whose numbers differ only in digit r (base fanout) meet, each gets the
roots of all, and each hashes the common ancestor itself. After as many rounds as the number of blocks has digits, every block
holds the root and the runs of siblings above it; nothing is sent downward.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard, remainder, table

FANOUT = 16
#: Levels that a block hashes by itself.
LEVELS = 2
#: Blocks of a group that share one copy of what lies above the group.
BLOCKS_A_COPY = 256
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def _folded(nodes: Column, fanout: int) -> Column:
    """The parents of nodes in order."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fanout).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(nodes, i * fanout + 1, F.lit(fanout)), "")))


def _dealt(rows: DataFrame, group: str, order: list[str], fanout: int) -> DataFrame:
    """rows in blocks: (group, block, n: leaves of the group, rows: array of structs in order, at: their place in the block)."""
    keys = [group, *[c for c in order if c != group]]
    # the rows stand in order over the partitions once; the places in each and the numbers before it give the place in the group
    spread = cut(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    counts = spread.groupBy(group, "_part").agg(F.count("*").alias("_in"))
    whole = Window.partitionBy(group)
    before = F.sum("_in").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_in")
    counts = counts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), before.alias("_before"), F.sum("_in").over(whole).alias("_n"))
    ranked = spread.withColumn("_row", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)))
    ranked = ranked.join(counts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    place = F.col("_before") + F.col("_row") - 1
    size = fanout**LEVELS
    own = F.struct((place % size).cast("int").alias("_at"), *rows.columns)
    blocks = ranked.groupBy(group, F.floor(place / size).alias("block")).agg(F.first("_n").alias("n"), F.array_sort(F.collect_list(own)).alias("rows"))
    out = cut(blocks)
    discard(spread)
    return out


def _exchange(state: DataFrame, group: str, r: int, fanout: int) -> DataFrame:
    """One round: blocks whose numbers differ in digit r alone meet, and all of them get the run of their roots.

    Where the last node of a level has too few blocks to meet all, each of these stands in for the missing ones at equal steps.
    """
    span = fanout**r
    blocks, block = F.col("blocks"), F.col("block")
    node, nodes, low = F.floor(block / span), F.ceil(blocks / span), block % span
    missing = (node == nodes - 1) & (blocks - node * span < span)
    lows = F.sequence(low, F.when(missing, F.lit(span - 1)).otherwise(low), F.when(missing, blocks - node * span).otherwise(F.lit(1)).cast("long"))
    sent = state.select(group, "blocks", block, "root", "path", node.alias("_node"), low.alias("_own"), (nodes > 1).alias("_open"), F.explode(lows).alias("_low"))
    member = F.col("_low") == F.col("_own")
    letter = F.struct((F.col("_node") % fanout).cast("int").alias("at"), "root", member.alias("member"), F.when(member, block).alias("block"), F.when(member, F.col("path")).alias("path"))
    met = sent.groupBy(group, "blocks", "_open", F.floor(F.col("_node") / fanout).alias("_parent"), "_low").agg(F.array_sort(F.collect_list(letter)).alias("_met"))
    met = met.withColumn("_run", F.transform("_met", lambda m: m["root"])).withColumn("_up", digest(F.array_join("_run", "")))
    each = met.select(group, "blocks", "_open", "_run", "_up", F.explode(F.filter("_met", lambda m: m["member"])).alias("m"))
    step = F.array(F.struct(F.col("m.at").alias("at"), F.col("_run").alias("run")))
    return each.select(
        group, "blocks", F.col("m.block").alias("block"), F.when(F.col("_open"), F.col("_up")).otherwise(F.col("m.root")).alias("root"), F.when(F.col("_open"), F.concat("m.path", step)).otherwise(F.col("m.path")).alias("path")
    )


def tree(rows: DataFrame, group: str, order: list[str], leaf: str = "leaf", fanout: int = FANOUT) -> DataFrame:
    """The Merkle tree of each group's leaves in order: one row for each block of fanout^2 leaves.

    Returns (group, block, n, rows, root, path): n leaves of the group, its root, the block's rows in order (with `_at`), and the
    runs above the block from below (each with the block's place in it). Null groups are a group. While several nodes remain,
    every `fanout` consecutive ones, or fewer at the end, become the digest of their joined digests; a lone leaf is the root. Rows
    equal in all of `order` are in no stated order among themselves, so put the leaf last in it. An empty table has no blocks.
    """
    blocks = _dealt(rows, group, order, fanout)
    level, state = F.transform("rows", lambda x: x[leaf]), blocks
    for k in range(LEVELS):
        level = F.when(F.col("n") > fanout**k, _folded(level, fanout)).otherwise(level)
        state = state.withColumn("_level", level)
        level = F.col("_level")
    state = state.select(group, "block", F.ceil(F.col("n") / fanout**LEVELS).alias("blocks"), F.get("_level", F.lit(0)).alias("root"), F.array().cast("array<struct<at:int,run:array<string>>>").alias("path"))
    most = blocks.agg(F.max("block")).first()[0] or 0
    old = state = cut(state)
    r = 0
    while fanout**r <= most:
        state = cut(_exchange(state, group, r, fanout))
        discard(old)
        old, r = state, r + 1
    above = state.select(F.col(group).alias("_g"), F.col("block").alias("_b"), "root", "path")
    return blocks.join(above, F.col(group).eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b"))).drop("_g", "_b")


def leaf_paths(blocks: DataFrame, leaf: str = "leaf", fanout: int = FANOUT) -> DataFrame:
    """tree()'s rows one by one, with their columns, `root` and `path` from the leaf up."""
    levels, nodes = [], F.transform("rows", lambda x: x[leaf])
    for k in range(LEVELS):
        levels.append(nodes)
        nodes = _folded(nodes, fanout)
    names = [f"_l{k}" for k in range(LEVELS)]
    out = blocks.withColumns(dict(zip(names, levels, strict=True)))
    out = out.select(*names, "n", "root", F.col("path").alias("_above"), F.explode("rows").alias("_row"))
    at = F.col("_row._at")
    steps = [
        F.when(F.col("n") > fanout**k, F.array(F.struct((F.floor(at / fanout**k) % fanout).cast("int").alias("at"), F.slice(name, (F.floor(at / fanout ** (k + 1)) * fanout + 1).cast("int"), F.lit(fanout)).alias("run"))))
        .otherwise(F.array().cast("array<struct<at:int,run:array<string>>>"))
        for k, name in enumerate(names)
    ]
    return out.select("_row.*", "root", F.concat(*steps, "_above").alias("path")).drop("_at")


def siblings(path: Column) -> Column:
    """The other digests of each run, level by level, left to right, end to end."""
    return F.array_join(F.transform(path, lambda s: F.array_join(F.concat(F.slice(s["run"], F.lit(1), s["at"]), F.slice(s["run"], s["at"] + 2, F.size(s["run"]))), "")), "")


def recomputed(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda h, s: digest(F.concat(F.array_join(F.slice(s["run"], F.lit(1), s["at"]), ""), h, F.array_join(F.slice(s["run"], s["at"] + 2, F.size(s["run"])), ""))))


def manifest(rows: DataFrame, group: str, order: list[str], leaf: str = "leaf", fanout: int = FANOUT) -> DataFrame:
    """Proofs for each row of a table of leaves (strings of hex digits), whose groups' roots, in order of the groups, lead to one root.

    Returns rows' columns, subroot (of the group), root, and path (array of at, run: the place in each run from the leaf up, through
    the group's root). Columns named like these three are replaced. Null groups come first, as one group; nulls in `order` come
    first; rows equal in `order` may change places. An empty table gives an empty table.
    """
    rows = rows.drop("subroot", "root", "path", "block", "n", "blocks", "rows", "_at")
    blocks = tree(rows, group, order, leaf, fanout)
    tops = blocks.where("block = 0").select(F.lit(0).alias("_all"), F.col(group).alias("_group"), F.col("root").alias("_sub"), "n")
    upper = leaf_paths(tree(tops.withColumnRenamed("n", "_size"), "_all", ["_group"], "_sub", fanout), "_sub", fanout)
    copies = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_size") - 1) / (fanout**LEVELS * BLOCKS_A_COPY)))
    upper = upper.select("_group", F.col("root").alias("_root"), F.col("path").alias("_path"), F.explode(copies).alias("_copy"))
    both = blocks.join(upper, F.col(group).eqNullSafe(F.col("_group")) & (F.floor(F.col("block") / BLOCKS_A_COPY) == F.col("_copy")))
    # what is above the group rides in the rows' path; its root goes along as a column of the block
    each = leaf_paths(both.withColumn("path", F.concat("path", "_path")).withColumn("root", F.struct(F.col("root").alias("sub"), F.col("_root").alias("all"))), leaf, fanout)
    return each.select(*rows.columns, F.col("root.sub").alias("subroot"), F.col("root.all").alias("root"), "path")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    of = lambda text: digest(F.concat(*[field(text if c == "text" else F.col(c)) for c in FIELDS]))
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    leaves = docs.select("doc_id", "source", of(F.col("text")).alias("leaf"), F.when(remainder() == 0, of(lower)).alias("tampered"))
    got = manifest(leaves, "source", ["doc_id", "leaf"])
    folded = recomputed(F.coalesce("tampered", "leaf"), F.col("path"))
    out = got.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql() -> str:
    """The same for DuckDB, with seven levels in a group and five above, and crc32 bit by bit."""
    crc = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: list_concat([ord(x)::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))), lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"
    shown = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    of = lambda text: "sha256(" + " || ".join(shown(text if c == "text" else c) for c in FIELDS) + ")"
    parts = [
        f"""leaves AS (SELECT doc_id, source, leaf, tampered, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM (
            SELECT doc_id, source, {of("text")} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {of(f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")} END AS tampered FROM documents))"""
    ]

    def levels(name: str, start: str, deep: int) -> None:
        parts.append(f"{name}0 AS ({start})")
        for k in range(deep):
            parts.append(f"{name}runs{k} AS (SELECT g, i // 16 AS up, n, list(h ORDER BY i) AS run FROM {name}{k} GROUP BY ALL)")
            parts.append(f"{name}{k + 1} AS (SELECT g, up AS i, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS h FROM {name}runs{k})")

    def climb(frm: str, name: str, deep: int) -> str:
        for k in range(deep):
            at = f"(p // {16**k}) % 16"
            others = f"array_to_string(r.run[1:{at}], '') AS low, array_to_string(r.run[{at} + 2:16], '') AS high"
            parts.append(
                f"""{name}_{k} AS (SELECT * EXCLUDE (low, high, proof, acc, many), CASE WHEN many THEN proof || low || high ELSE proof END AS proof, CASE WHEN many THEN sha256(low || acc || high) ELSE acc END AS acc
                FROM (SELECT f.*, r.n > 1 AS many, {others} FROM {frm} f JOIN {name}runs{k} r ON f.g IS NOT DISTINCT FROM r.g AND r.up = f.p // {16 ** (k + 1)}))"""
            )
            frm = f"{name}_{k}"
        return frm

    levels("a", "SELECT source AS g, i, n, leaf AS h FROM leaves", 7)
    levels("b", "SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h FROM a7", 5)
    parts.append("tops AS (SELECT g AS source, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS place FROM a7)")
    parts.append("start AS (SELECT doc_id, leaf, source AS g, i AS p, '' AS proof, coalesce(tampered, leaf) AS acc FROM leaves)")
    low = climb("start", "a", 7)
    parts.append(f"middle AS (SELECT f.doc_id, f.leaf, t.subroot, 0 AS g, t.place AS p, f.proof, f.acc FROM {low} f JOIN tops t ON f.g IS NOT DISTINCT FROM t.source)")
    top = climb("middle", "b", 5)
    return f"WITH {', '.join(parts)} SELECT f.doc_id, f.leaf, f.subroot, b5.h AS root, sha256(f.proof) AS proof_sha256, f.acc AS folded_root, f.acc = b5.h AS verified FROM {top} f, b5"


ORACLE_SQL = _sql()
