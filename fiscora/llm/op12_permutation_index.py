"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its PLACES nearest of PIVOTS pivots, nearest first. Vectors are dealt to
shards by a hash of their id; each shard posts its vectors in the inverted files of their pivots (member,
place) and keeps them beside. A query block meets each shard once: the files of the queries' own pivots
are read, footrule distances are summed, the nearest SHARE of the shard and all ties with its last one
are scored exactly, and the shard's best go on. Best lists of shards are merged a few at a time.

Inner products are turned into angles by one more component, so that norms may differ: a vector x of the
longest norm M gets sqrt(M^2 - x^2), a query 0.

The footrule distance of two prefixes, absent pivots standing at place PLACES, is a constant less twice
the sum over shared pivots of PLACES - max(place, place); the files give that sum.

The pivots are a bounded sample (PIVOTS distinct vectors of least hash); every vector is indexed and no
bucket has a cap: the share grows with the shard. share=1.0 scores everything: the exact search.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part,
nor do those of another length than most have (the shorter on ties); of several rows with one id the one
with the least vector stands for it; rows without an id are candidates, last among ties, and no queries;
an empty table has an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscora.llm.common import written

PIVOTS, PLACES, SHARE = 256, 48, 0.3
#: Components in a shard, queries in a block, best lists that are merged together.
SHARD_VALUES, BLOCK, TOGETHER = 1 << 17, 2048, 64
#: A shard scores this many times k vectors at least.
LEAST = 10

SHARD = "shard int, ids array<long>, vectors binary, starts array<int>, members array<int>, places array<short>"
SHARD_ARROW = pa.schema([("shard", pa.int32()), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("starts", pa.list_(pa.int32())), ("members", pa.list_(pa.int32())), ("places", pa.list_(pa.int16()))])
FOUND = "query_id long, part int, best array<struct<far:double,nameless:boolean,vec_id:long>>"
FOUND_ARROW = pa.schema([("query_id", pa.int64()), ("part", pa.int32()), ("best", pa.list_(pa.struct([("far", pa.float64()), ("nameless", pa.bool_()), ("vec_id", pa.int64())])))])


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<double>, squares): vectors that take part, whatever their length."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(fine).withColumn("squares", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))


def one_for_each_id(rows: DataFrame) -> DataFrame:
    named = rows.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("v").alias("v"))
    return named.unionByName(rows.where("vec_id IS NULL").select("vec_id", "v"))


def pivots_of(rows: DataFrame, n: int) -> list[list[float]]:
    """The n distinct vectors of least hash."""
    hashed = rows.select(F.xxhash64("v").alias("h"), "v").dropDuplicates(["h"])
    return [r["v"] for r in hashed.orderBy("h").limit(n).collect()]


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the component that makes all of them as long as the longest."""
    rest = np.sqrt(np.maximum(longest**2 - np.einsum("ij,ij->i", x, x), 0))
    return np.column_stack([x, rest])


def permutations(x: np.ndarray, pivots: np.ndarray, places: int) -> np.ndarray:
    """The nearest pivots of each row of x, nearest first."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :places]


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), np.float64).reshape(-1, dim)


def shared_places(own: np.ndarray, starts: np.ndarray, members: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """For each query (its pivots: a row of own) and each of the n vectors of a shard the sum over shared
    pivots of width - max(place, place): as large as the footrule distance is small."""
    width = own.shape[1]
    out = np.zeros((len(own), n), np.int32)
    order = np.argsort(own, axis=None, kind="stable")
    ends = np.searchsorted(own.reshape(-1)[order], np.arange(len(starts)))
    for p in range(len(starts) - 1):
        asked, posted = order[ends[p] : ends[p + 1]], slice(starts[p], starts[p + 1])
        if len(asked) and posted.stop > posted.start:
            near = width - np.maximum((asked % width)[:, None], places[posted][None])
            out[np.ix_(asked // width, members[posted])] += near.astype(np.int32)
    return out


def build_index(rows: DataFrame, pivots: np.ndarray, longest: float, shards: int, places: int = PLACES) -> DataFrame:
    """A row for each shard of rows (vec_id, v): its vectors and, one behind the other, its pivots'
    inverted files; file p is members and places from starts[p] to starts[p + 1]."""
    dim = pivots.shape[1] - 1

    def build(table: pa.Table) -> pa.Table:
        x = matrix(table.column("v"), dim)
        near = permutations(lifted(x, longest), pivots, places)
        order = np.argsort(near, axis=None, kind="stable")
        starts = np.searchsorted(near.reshape(-1)[order], np.arange(len(pivots) + 1))
        row = [[table.column("shard")[0].as_py()], [table.column("vec_id").to_pylist()], [x.tobytes()], [starts], [order // near.shape[1]], [order % near.shape[1]]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(row, SHARD_ARROW, strict=True)], schema=SHARD_ARROW)

    # Rows without an id are dealt by their vectors.
    key = F.pmod(F.xxhash64("vec_id", F.when(F.col("vec_id").isNull(), F.col("v"))), F.lit(shards)).cast("int")
    return rows.select(key.alias("shard"), "vec_id", "v").groupBy("shard").applyInArrow(build, SHARD)


def search(index: DataFrame, queries: DataFrame, blocks: int, shards: int, pivots: np.ndarray, k: int, share: float, places: int = PLACES) -> DataFrame:
    """(query_id, best): the k nearest vectors of each of queries (vec_id, v). Each query block meets each
    shard in a task's group of its own: a shard and a block are all that it holds."""
    dim = pivots.shape[1] - 1

    def pack(table: pa.Table) -> pa.Table:
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "ids": pa.array([table.column("vec_id").to_pylist()], pa.list_(pa.int64())), "vectors": pa.array([matrix(table.column("v"), dim).tobytes()], pa.binary())})

    def meet(shard: pa.Table, block: pa.Table) -> pa.Table:
        if not shard.num_rows or not block.num_rows:
            return FOUND_ARROW.empty_table()
        s, b = shard.to_pylist()[0], block.to_pylist()[0]
        x, q = (np.frombuffer(r["vectors"], np.float64).reshape(-1, dim) for r in (s, b))
        nameless = np.array([i is None for i in s["ids"]])
        ids = np.array([0 if i is None else i for i in s["ids"]], np.int64)
        own = permutations(np.column_stack([q, np.zeros(len(q))]), pivots, places)
        near = shared_places(own, np.array(s["starts"]), np.array(s["members"], np.int64), np.array(s["places"], np.int64), len(x))
        depth = min(len(x), max(int(np.ceil(share * len(x))), LEAST * k) + 1)  # one more for the query itself
        least = np.partition(near, len(x) - depth, axis=1)[:, len(x) - depth]
        out = []
        for query, vector, sums, cut in zip(b["ids"], q, near, least, strict=True):
            at = np.flatnonzero((sums >= cut) & (nameless | (ids != query)))
            score = (x[at] * vector).sum(axis=1) + 0.0  # row by row alike, so that copies tie
            if len(at) > k:
                keep = score >= np.partition(score, len(at) - k)[len(at) - k]
                at, score = at[keep], score[keep]
            first = np.lexsort((ids[at], nameless[at], -score))[:k]
            out.append([{"far": -score[j], "nameless": nameless[at[j]], "vec_id": None if nameless[at[j]] else ids[at[j]]} for j in first])
        return pa.Table.from_arrays([pa.array(b["ids"], pa.int64()), pa.array([s["shard"]] * len(q), pa.int32()), pa.array(out, FOUND_ARROW.field("best").type)], schema=FOUND_ARROW)

    key = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    packed = written(queries.select(key.alias("block"), "vec_id", "v").groupBy("block").applyInArrow(pack, "block int, ids array<long>, vectors binary"), "queries")
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("shard", "block")
    right = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).groupBy("shard", "block")
    found = written(left.cogroup(right).applyInArrow(meet, FOUND), "found")
    while True:  # a list has k entries, a merge TOGETHER lists: no key gathers more
        shards = -(-shards // TOGETHER)
        best = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k)
        found = found.withColumn("part", (F.col("part") / TOGETHER).cast("int")).groupBy("query_id", "part").agg(best.alias("best"))
        if shards == 1:
            return found.select("query_id", "best")
        found = written(found, "found")


def nearest(vectors: DataFrame, is_query: Column, k: int, share: float = SHARE, pivots: int = PIVOTS, places: int = PLACES, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by inner product of the rows for which is_query (over
    vec_id) holds, among all others."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    most = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max("squares").alias("squares")).orderBy(F.desc("n"), "dim").first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = written(one_for_each_id(rows.where(F.size("v") == most["dim"])), "vectors")
    longest, shards = float(np.sqrt(most["squares"])), -(-most["n"] * most["dim"] // SHARD_VALUES)
    sample = lifted(np.array(pivots_of(rows, pivots), np.float64), longest)
    queries = rows.where(F.col("vec_id").isNotNull() & is_query)
    blocks = max(1, -(-queries.count() // BLOCK))
    index = written(build_index(rows, sample, longest, shards, places), "index")
    found = search(index, queries, blocks, shards, sample, k, share, places)
    return found.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.far")).alias("score"))


def op12_permutation_index(vectors: DataFrame) -> DataFrame:
    """The 20 nearest of every twentieth id."""
    return nearest(vectors, F.col("vec_id") % 20 == 0, 20)
