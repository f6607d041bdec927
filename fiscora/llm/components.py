"""Connected components of a distributed edge list, by alternating large-star and small-star
rounds.

Edges are first contracted inside each partition, without a shuffle. A round takes the least
neighbour of each node by an aggregation with partial sums, writes these as a table, and joins them
back; both sides of that join are shuffled as they are read, so adaptive execution can split a hub
with a third of all edges. Each round ends in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscora.llm.common import written

#: Edges that are contracted together inside a partition.
TOGETHER = 200_000


def contracted(pairs: Iterator[tuple]) -> dict:
    """Each node that is not the least of its component, and that least node."""
    up: dict = {}

    def root(x):
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, kinds = [], 0, None

    def out() -> pa.RecordBatch:
        found = contracted((a, b) for x in held for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), kinds[0]), pa.array(found.values(), kinds[1])], names=["a", "b"])

    for batch in batches:
        kinds = [f.type for f in batch.schema]
        held.append(batch)
        size += batch.num_rows
        if size >= TOGETHER:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _least(rows: DataFrame, name: str) -> DataFrame:
    """(u, m): the least b, or a itself, of each a of rows (a, b)."""
    return written(rows.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), name)


def stars(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b) but the least one of each component, which is
    the component's name.

    Self-loops are dropped; repeated edges count once; an empty list gives an empty result. Nodes
    may be of any type that has an order.
    """
    kind = edges.schema["a"].dataType.simpleString()
    now = written(edges.where("a <> b").select("a", "b").mapInArrow(_contract, f"a {kind}, b {kind}"), "edges")
    while True:
        # A forest of stars is done: each node has one edge, and its end has none.
        ends = now.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        wrong = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)")
        if not wrong.limit(1).count():
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both, "least")
        large = written(both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")), "large")
        small = large.join(_least(large, "least"), F.col("a") == F.col("u"))
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select(F.col("e.a"), F.col("e.b")).where("a <> b").distinct()
        now = written(small.mapInArrow(_contract, f"a {kind}, b {kind}"), "small")


def components(edges: DataFrame) -> DataFrame:
    """stars(), and a row for the least node of each component as well."""
    found = written(stars(edges), "stars")
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
