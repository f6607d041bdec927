"""Merkle manifest of a table: one tree for each group (language), one tree over the groups' roots.

Leaves get their place in their group by a range partitioning and the counts of its parts. Blocks of
2^HEIGHT consecutive nodes are reduced to one node by one task each, again and again, until TOP nodes at
most are left; only these reach the driver, which builds the top tree and hands back each node's suffix
path. The suffixes join the blocks that the nodes stand for, level by level downwards, so that each row
ends with its own path, with which it folds its leaf to the root. Hashing is sha2 in the JVM.

Where there are more groups than TOP, each group is first reduced to one node; these are then numbered
in the order of the groups and reduced as one tree.

Defined results: rows without an id come first in their group; rows with one id are ordered by their
leaf; the group null comes first and differs from the group of the empty text; an empty table has an
empty result; a row that is alone in its table has an empty path. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiscora.llm.common import if_small, partitions, written

#: A block has 2^HEIGHT nodes; the driver gets TOP nodes at most (65 bytes and their paths each).
HEIGHT, TOP = 10, 4096
STEP = "array<struct<sibling:string,first:boolean>>"


def H(text: Column) -> Column:
    return F.sha2(text, 256)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def row_leaf(fields: list[Column]) -> Column:
    """The leaf of a row: each field `-` if null, else its UTF-8 bytes, `:` and its text."""
    return H(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in fields]))


def numbered(leaves: DataFrame, order: list[Column]) -> DataFrame:
    """leaves (grp, ...) with `i`, their place in their group: the number inside a part of the range
    partitioning, and the rows of the group in the parts before it."""
    spark = leaves.sparkSession
    ranged = leaves.repartitionByRange(partitions(spark), "grp", *order).sortWithinPartitions("grp", *order)
    parts = written(ranged.select("*", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % (1 << 33)).alias("at")), "ranged")
    # A row for each group of each part: as many as parts and groups together.
    held = parts.groupBy("grp", "part").agg(F.min("at").alias("from"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = if_small(held.select("grp", "part", (F.coalesce(before, F.lit(0)) - F.col("from")).alias("shift")))
    return parts.join(starts, ["grp", "part"]).withColumn("i", F.col("at") + F.col("shift")).drop("part", "at", "shift")


@dataclass
class Round:
    """One reduction: what was reduced, with the name (up_grp, up_i) of the node it became part of and
    the path to it, and the nodes that came of it."""

    members: DataFrame
    nodes: DataFrame


def _levels(first: Column, height: Column) -> Column:
    """All levels of a block's tree from its nodes up."""
    node = lambda level, k: F.get(level, k.cast("int"))
    pair = lambda level, k: H(F.concat(node(level, 2 * k), F.coalesce(node(level, 2 * k + 1), F.lit(""))))
    parents = lambda level: F.transform(F.sequence(F.lit(0), ((F.size(level) + 1) / 2).cast("int") - 1), lambda k: pair(level, k))
    steps = F.when(height > 0, F.sequence(F.lit(1), height)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(first), lambda acc, _: F.concat(acc, F.array(parents(F.element_at(acc, -1)))))


def reduced(nodes: DataFrame, height: int, name: str) -> Round:
    """Blocks of 2^height consecutive nodes (grp, i, hash, ...) become a node each. A group that has no
    more than one block ends at its root. No block has more nodes than that, whatever its group's size."""
    payload = [c for c in nodes.columns if c not in ("grp", "i")]
    sizes = if_small(nodes.groupBy("grp").agg(F.max("i").alias("last")))
    blocks = nodes.join(sizes, "grp").withColumn("block", F.shiftright("i", height))
    blocks = blocks.groupBy("grp", "block").agg(F.array_sort(F.collect_list(F.struct("i", *payload))).alias("rows"), F.first("last").alias("last"))
    # Levels to climb: all of them, or as many as a lone block has (the bits of its last number).
    own = F.when(F.col("last") < (1 << height), F.when(F.col("last") > 0, F.length(F.bin("last"))).otherwise(0)).otherwise(height)
    blocks = blocks.withColumn("height", own).withColumn("levels", _levels(F.transform("rows", lambda r: r["hash"]), F.col("height")))
    at = lambda i, level: F.shiftright(i, 0) if level is None else F.call_function("shiftright", i, level)

    def path(i: Column) -> Column:
        local = (i % (1 << height)).cast("int")
        steps = F.when(F.col("height") > 0, F.sequence(F.lit(0), F.col("height") - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(steps, lambda level: F.struct(F.get(F.get("levels", level), at(local, level).bitwiseXOR(F.lit(1))).alias("sibling"), (at(local, level) % 2 == 1).alias("first")))

    rows = F.transform("rows", lambda r: F.struct(r["i"].alias("i"), *[r[c].alias(c) for c in payload], path(r["i"]).alias("path")))
    done = written(blocks.select("grp", "block", rows.alias("rows"), F.element_at(F.element_at("levels", -1), 1).alias("hash")), name)
    members = done.select("grp", F.col("grp").alias("up_grp"), F.col("block").alias("up_i"), F.explode("rows").alias("r")).select("grp", "r.*", "up_grp", "up_i")
    return Round(members, done.select("grp", F.col("block").alias("i"), "hash"))


def _pairs(level: list[str]) -> list[str]:
    return [digest("".join(level[k : k + 2])) for k in range(0, len(level), 2)]


def _climbed(level: list[str]) -> tuple[str, list[list[tuple]]]:
    """The root above these nodes, and each one's path to it."""
    paths: list[list[tuple]] = [[] for _ in level]
    under = [[k] for k in range(len(level))]
    while len(level) > 1:
        for k, own in enumerate(under):
            sibling = level[k ^ 1] if k ^ 1 < len(level) else None
            for leaf in own:
                paths[leaf].append((sibling, bool(k & 1)))
        under = [sum(under[k : k + 2], []) for k in range(0, len(level), 2)]
        level = _pairs(level)
    return level[0], paths


def top_tree(nodes: list[tuple[str, int, str]]) -> list[tuple]:
    """(grp, i, suffix path, subroot, root) of the nodes that are left, group after group."""
    groups: dict[str, list[tuple[int, str]]] = {}
    for grp, i, node in nodes:
        groups.setdefault(grp, []).append((i, node))
    order = sorted(groups, key=lambda g: g.encode())
    own = {g: _climbed([node for _, node in sorted(groups[g])]) for g in order}
    root, above = _climbed([own[g][0] for g in order])
    return [(g, i, own[g][1][k] + above[n], own[g][0], root) for n, g in enumerate(order) for k, (i, _) in enumerate(sorted(groups[g]))]


def merkle_paths(leaves: DataFrame, order: list[Column], height: int = HEIGHT, top: int = TOP) -> DataFrame:
    """leaves (grp, hash, ...) with `path` (sibling, first: whether it stands before) from each leaf to
    the root, `subroot` and `root`."""
    spark = leaves.sparkSession
    nodes, rounds, singles = numbered(leaves, order), [], None
    while True:
        rounds.append(reduced(nodes, height, "merkle"))
        nodes = rounds[-1].nodes
        left = nodes.agg(F.count("*").alias("n"), F.max("i").alias("last")).first()
        if not left["n"]:
            return rounds[0].members.drop("up_grp", "up_i", "i").select("*", F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("root"))
        if left["n"] <= top:
            break
        if left["last"] == 0 and singles is None:
            # One node for each group, and too many groups: they are numbered as one tree.
            singles = numbered(nodes.select(F.lit("").alias("grp"), F.col("grp").alias("own"), "hash"), [F.col("own")])
            nodes = singles.select("grp", "i", "hash", "own")
            singles = len(rounds)
    found = [(r["grp"], r["i"], r["hash"]) for r in nodes.select("grp", "i", "hash").collect()]
    # At most `top` rows, with as many steps as the top tree has levels: small enough to broadcast.
    suffix = F.broadcast(spark.createDataFrame(top_tree(found), f"up_grp string, up_i long, suffix {STEP}, subroot string, root string"))
    for k in reversed(range(len(rounds))):
        below = rounds[k].members.join(suffix, ["up_grp", "up_i"]).withColumn("path", F.concat("path", "suffix")).drop("up_grp", "up_i", "suffix")
        if not k:
            return below.drop("i")
        if k == singles:  # what was numbered here are the groups' own roots
            below = below.select(F.col("own").alias("up_grp"), F.lit(0).cast("long").alias("up_i"), F.col("path").alias("suffix"), F.col("hash").alias("subroot"), "root")
        else:
            below = below.select(F.col("grp").alias("up_grp"), F.col("i").alias("up_i"), F.col("path").alias("suffix"), "subroot", "root")
        suffix = written(below, "suffix")
    raise AssertionError


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with its path."""
    empty = F.lit("")
    return F.aggregate(path, leaf, lambda acc, s: H(F.when(s["first"], F.concat(s["sibling"], acc)).otherwise(F.concat(acc, F.coalesce(s["sibling"], empty)))))


def proof_digest(path: Column) -> Column:
    """The hash of a path's siblings, from the leaf to the root."""
    return H(F.concat_ws("", F.transform(path, lambda s: s["sibling"])))


def op13_merkle_manifest(docs: DataFrame, height: int = HEIGHT, top: int = TOP) -> DataFrame:
    """The manifest of documents, and the fold of each row, every seventh or so tampered with."""
    kinds = {"doc_id": "decimal(20,0)", "n_chars": "decimal(20,0)"}
    fields = {c: F.col(c).cast(kinds[c]).cast("string") if c in kinds else F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    more = fields | {"n_chars": (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")}
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    grp = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    leaves = docs.select(grp.alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), row_leaf(list(fields.values())).alias("hash"), F.when(tampered, row_leaf(list(more.values()))).alias("changed"))
    paths = merkle_paths(leaves, [F.col("doc_id").asc_nulls_first(), F.col("hash")], height, top)
    out = paths.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("changed", "hash"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
