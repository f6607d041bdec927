"""Mixing sources to target weights by temperature.

A source with a share p of all tokens gets the weight p^a / sum of all p^a. The exponent a is found
by bisection (many points a pass, over the table of sources): the largest one at which the weights
reach the target entropy, but no smaller than what keeps every source within the repetition limit.

The weights are then realised within a token budget. A source's quota is a number of whole epochs
and a rest. Its documents are dealt into blocks of about BLOCK_DOCS by a keyed hash, blocks are
permuted by another; the rest takes whole blocks in that order and a part of the next one, in the
order of a document hash. Sums run over blocks and, inside the single cut block of a source, over
its documents, so a source with a third of all rows never meets in one task. A row's number of
copies follows from its own hashes and one row for each source; rows are not sorted.

Defined results: without a budget, the smallest one that uses every document once; a null source is
a source of its own; null and empty texts have no tokens; a source without tokens keeps each row
once; rows with one id and one text are taken or left together, others each for themselves; an empty table gives an empty result; other columns
stay as they are in mix_documents().
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiscora.llm.common import if_small, written

BLOCK_DOCS = 1024
POINTS, PASSES = 65, 5


@dataclass(frozen=True)
class Target:
    """Entropy as a share of that of equal weights, the most epochs of a source, a token budget
    (None: the smallest that uses every document) and the key of the permutations."""

    entropy: float = 0.98
    repetition: float = 4.0
    budget: float | None = None
    key: int = 20_011


def token_count(text: Column) -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    return F.coalesce(source.cast("string"), F.lit("\0null"))


def exponent(sources: DataFrame, target: Target) -> tuple[float, float]:
    """(a, sum of p^a) for sources (src, p) with p > 0."""
    low, high = 0.0, 1.0
    ends = sources.agg(F.count("*").alias("n"), F.min("p").alias("least"), F.max("p").alias("most")).first()
    if not ends["n"]:
        return 1.0, 1.0
    wanted = target.entropy * math.log(ends["n"])
    norm = 1.0
    for _ in range(PASSES):
        grid = [low + (high - low) * i / (POINTS - 1) for i in range(POINTS)]
        power = F.pow("p", F.col("a"))
        rows = sources.select("p", F.explode(F.array(*map(F.lit, grid))).alias("a")).groupBy("a").agg(F.sum(power).alias("s"), F.sum(power * F.log("p")).alias("t")).orderBy("a").collect()
        fits = []
        for r in rows:
            epochs = (ends["least"] ** (r["a"] - 1) / r["s"]) * (target.budget or ends["most"] ** (1 - r["a"]) * r["s"])
            fits.append((math.log(r["s"]) - r["a"] * r["t"] / r["s"] >= wanted - 1e-12, epochs <= target.repetition + 1e-12))
        # Entropy falls and repetition falls as a grows: the last point with the entropy, or the
        # first within the limit, whichever is larger.
        by_entropy = max((i for i, f in enumerate(fits) if f[0]), default=0)
        by_limit = min((i for i, f in enumerate(fits) if f[1]), default=POINTS - 1)
        if by_limit > by_entropy:
            at, low, high = by_limit, grid[max(by_limit - 1, 0)], grid[by_limit]
        else:
            at, low, high = by_entropy, grid[by_entropy], grid[min(by_entropy + 1, POINTS - 1)]
        found, norm = grid[at], rows[at]["s"]
    return found, norm


def _hash(key: int, *columns) -> Column:
    return F.xxhash64(F.lit(key), *columns)


def plan(stats: DataFrame, target: Target) -> DataFrame:
    """One row for each source of stats (place, src, n_tokens): weight, blocks, whole epochs, and
    where its last, partial epoch is cut (hash of the cut block and of the last document in it)."""
    totals = written(stats.groupBy("src").agg(F.sum("n_tokens").cast("double").alias("tokens"), F.count("*").alias("docs")), "sources")
    total = totals.agg(F.sum("tokens")).first()[0] or 0.0
    shares = totals.where("tokens > 0").select("src", (F.col("tokens") / (total or 1.0)).alias("p"))
    relative = Target(target.entropy, target.repetition, target.budget / total if target.budget and total else None, target.key)
    a, norm = exponent(shares, relative)
    most = shares.agg(F.max("p")).first()[0] or 1.0
    budget = target.budget or total * most ** (1 - a) * norm
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / (total or 1.0), F.lit(a)) / norm).otherwise(0.0)
    quota = F.when(F.col("tokens") > 0, weight * budget).otherwise(0.0)
    # A thousandth of a token is rounding, not a quota.
    whole = F.when(F.col("tokens") > 0, F.floor((quota + 1e-3) / F.col("tokens"))).otherwise(1)
    sources = totals.select("src", "tokens", "docs", weight.alias("weight"), F.ceil(F.col("docs") / BLOCK_DOCS).alias("blocks"), whole.cast("long").alias("whole"), quota.alias("quota"))
    sources = written(sources.withColumn("rest", F.greatest(F.col("quota") - F.col("whole") * F.col("tokens"), F.lit(0.0))), "weights")
    placed = placed_in(stats, sources, target.key)
    blocks = placed.groupBy("src", "rest", "block_hash").agg(F.sum("n_tokens").alias("n"))
    up_to = F.sum("n").over(Window.partitionBy("src").orderBy("block_hash"))
    cuts = blocks.withColumn("up_to", up_to).where("up_to > rest").groupBy("src").agg(F.min(F.struct("block_hash", (F.col("up_to") - F.col("n")).alias("before"))).alias("c"))
    cuts = written(cuts.select("src", F.col("c.block_hash").alias("cut_block"), F.col("c.before").alias("before")), "cuts")
    inside = placed.join(if_small(cuts), "src").where("block_hash = cut_block")
    run = F.col("before") + F.sum("n_tokens").over(Window.partitionBy("src").orderBy("doc_hash"))
    last = inside.withColumn("run", run).where("run <= rest").groupBy("src").agg(F.max("doc_hash").alias("cut_doc"))
    return written(sources.join(cuts.drop("before"), "src", "left").join(last, "src", "left"), "plan")


def placed_in(rows: DataFrame, sources: DataFrame, key: int) -> DataFrame:
    """rows (place, src, ...) with the columns of their source and the hashes that order them."""
    block = F.pmod(_hash(key, "place"), F.col("blocks"))
    return rows.join(if_small(sources), "src").withColumn("block_hash", _hash(key + 1, "src", block)).withColumn("doc_hash", _hash(key + 2, "place"))


def place(key: int) -> Column:
    """What deals a row: its id and its text, so that rows without an id, or with the same one, are dealt apart."""
    return _hash(key + 3, F.col("doc_id").cast("long"), "text").alias("place")


def copies() -> Column:
    """Epochs that take a row: all whole ones, and the partial one up to its cut."""
    partial = F.col("rest") > 0
    taken = partial & (F.col("cut_block").isNull() | (F.col("block_hash") < F.col("cut_block")) | ((F.col("block_hash") == F.col("cut_block")) & (F.col("doc_hash") <= F.col("cut_doc"))))
    return F.col("whole") + F.coalesce(taken, F.lit(False)).cast("long")


def token_stats(docs: DataFrame, key: int) -> DataFrame:
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), place(key), source_key(F.col("source")).alias("src"), token_count(F.col("text")).alias("n_tokens")), "tokens")


def mix_documents(docs: DataFrame, target: Target = Target()) -> DataFrame:
    """docs (doc_id, text, source, ...) with each row as often as the mixture takes it."""
    sources = plan(token_stats(docs, target.key), target)
    packed = docs.select(F.struct(*docs.columns).alias("row"), source_key(F.col("source")).alias("src"), place(target.key))
    taken = placed_in(packed, sources, target.key).withColumn("copies", copies()).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op10_mixture(docs: DataFrame, target: Target = Target()) -> DataFrame:
    """One row for each copy of a document: doc_id, source, n_tokens, epoch and the source's weight."""
    stats = token_stats(docs, target.key)
    sources = plan(stats, target)
    taken = placed_in(stats, sources, target.key).withColumn("copies", copies()).where("copies > 0")
    return taken.select("doc_id", F.when(F.col("src") != "\0null", F.col("src")).alias("source"), "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("epoch"), "weight")
