"""Repeated runs of lines, found by prefix doubling over line-ID sequences, and deletion of their
later copies.

Places are (document, line number), in the order of doc_id. Suffixes of the line sequences are
ranked by prefix doubling: the rank of a suffix at depth 2^k is the first place whose 2^k lines are
the same, so it needs no global sort, names the interval of suffixes whose longest common prefix
has 2^k lines or more, and shows whether there is an earlier copy. Depth 2^(k+1) follows from the
pair of ranks at depth 2^k, 2^k lines apart. Suffixes alone in their interval drop out, and so do
stretches of repeated lines with too few words.

A maximal repeated run with at least min_words words is the union of its shortest windows with so
many words, those that begin at a line and those that end at one. A window of m lines lies in the
interval of the two overlapping ranks of depth 2^k <= m, so one aggregation tells whether the run
occurs earlier; the lines of all windows with an earlier copy are deleted. All of it is DataFrame
functions; sums are partial before each shuffle, and no group's rows are collected: a line or
passage in a third of all documents is one row of an aggregate, joined back.

Defined results: null texts stay null and have no lines; empty lines count as lines without words;
rows with the same doc_id are ordered by a hash of their text, and identical rows are treated alike
(as one place); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiscora.llm.common import written

MIN_WORDS = 50


def _place() -> Column:
    return F.struct("d", "t", "pos")


def _key(df: DataFrame) -> DataFrame:
    """d and t name a row: its doc_id (the least number for null) and a hash of its text."""
    return df.withColumn("d", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("t", F.xxhash64("text"))


def repeated_stretches(docs: DataFrame, min_words: int) -> DataFrame:
    """(d, t, seg, pos, words, before, upto, total, first, last, r0) of lines that occur more than
    once, in stretches of consecutive ones with min_words words or more. before and upto: words of
    the stretch before and up to the line."""
    lines = _key(docs.where("text IS NOT NULL")).select("d", "t", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = written(lines.select("d", "t", "pos", F.regexp_count("line", F.lit(r"\S+")).cast("long").alias("words"), F.unhex(F.md5(F.col("line").cast("binary"))).alias("id")), "lines")
    # Written first: both sides of the join are then plain shuffles, which adaptive execution splits.
    named = written(lines.groupBy("id").agg(F.min(_place()).alias("r0"), F.max(_place()).alias("most")).where("r0 < most").drop("most"), "named")
    # Repeated rows are one place.
    repeated = lines.join(named, "id").groupBy("d", "t", "pos").agg(F.first("words").alias("words"), F.first("r0").alias("r0"))
    own = Window.partitionBy("d", "t").orderBy("pos")
    repeated = repeated.withColumn("seg", F.col("pos") - F.row_number().over(own))
    stretch = Window.partitionBy("d", "t", "seg")
    upto = F.sum("words").over(stretch.orderBy("pos"))
    out = repeated.select("d", "t", "seg", "pos", "words", "r0", upto.alias("upto"), F.sum("words").over(stretch).alias("total"), F.min("pos").over(stretch).alias("first"), F.max("pos").over(stretch).alias("last"))
    return written(out.where(F.col("total") >= min_words).withColumn("before", F.col("upto") - F.col("words")), "stretches")


def doubled(rows: DataFrame, k: int) -> DataFrame:
    """rows with r{k+1}, from r{k}."""
    near = Window.partitionBy("d", "t", "seg").orderBy("pos").rangeBetween(2**k, 2**k)
    rank = f"r{k}"
    paired = rows.withColumn("a", F.col(rank)).withColumn("b", F.max(rank).over(near))
    both = paired.where("a IS NOT NULL AND b IS NOT NULL")
    named = written(both.groupBy("a", "b").agg(F.min(_place()).alias("name"), F.max(_place()).alias("most")).where("name < most").select(F.col("a").alias("a2"), F.col("b").alias("b2"), "name"), "named")
    joined = paired.join(named, (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")), "left")
    return joined.select(*rows.columns, F.col("name").alias(f"r{k + 1}"))


def repeated_windows(rows: DataFrame, min_words: int) -> DataFrame:
    """(d, t, pos, m): shortest windows of min_words words that have an earlier copy."""
    stretch = Window.partitionBy("d", "t", "seg")
    after = F.min("pos").over(stretch.orderBy("before").rangeBetween(min_words, Window.unboundedFollowing))
    until = F.max("pos").over(stretch.orderBy("upto").rangeBetween(Window.unboundedPreceding, -min_words))
    ends = F.coalesce(after - 1, F.when(F.col("total") - F.col("before") >= min_words, F.col("last")))
    starts = F.coalesce(until + 1, F.when(F.col("upto") >= min_words, F.col("first")))
    spans = rows.select("d", "t", "pos", ends.alias("e"), starts.alias("s"))
    forward = spans.where("e IS NOT NULL").select("d", "t", F.col("pos"), (F.col("e") - F.col("pos") + 1).alias("m"))
    backward = spans.where("s IS NOT NULL").select("d", "t", F.col("s").alias("pos"), (F.col("pos") - F.col("s") + 1).alias("m"))
    windows = written(forward.unionByName(backward).distinct(), "windows")
    longest = windows.agg(F.max("m")).first()[0] or 1
    depth = longest.bit_length() - 1
    for k in range(depth):
        rows = written(doubled(rows, k), "ranks")
    ranks = rows.select("d", "t", "pos", F.array(*[F.col(f"r{k}") for k in range(depth + 1)]).alias("ranks"))
    level = F.floor(F.log2(F.col("m").cast("double") + 0.5)).cast("int")
    asked = windows.withColumn("k", level).withColumn("other", F.expr("cast(pos + m - shiftleft(1, k) AS int)"))
    left = ranks.select("d", "t", "pos", F.col("ranks").alias("here"))
    right = ranks.select("d", "t", F.col("pos").alias("other"), F.col("ranks").alias("there"))
    met = asked.join(left, ["d", "t", "pos"]).join(right, ["d", "t", "other"])
    met = met.select("d", "t", "pos", "m", F.expr("here[k]").alias("a"), F.expr("there[k]").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    met = written(met, "met")
    first = written(met.groupBy("m", "a", "b").agg(F.min(_place()).alias("name"), F.max(_place()).alias("most")).where("name < most").drop("most"), "first")
    return met.join(first, ["m", "a", "b"]).where(_place() > F.col("name")).select("d", "t", "pos", "m")


def merged(windows: DataFrame) -> DataFrame:
    """(d, t, start, stop): windows that overlap or touch as one run of lines each, so that a text of many
    blank lines, whose windows are as long as it, costs a row for each window and not for each of their lines."""
    order = Window.partitionBy("d", "t").orderBy("pos", "m")
    spans = windows.select("d", "t", "pos", "m", (F.col("pos") + F.col("m") - 1).cast("int").alias("stop"))
    apart = F.col("pos") > F.coalesce(F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-2)) + 1
    runs = spans.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("d", "t", "run").agg(F.min("pos").cast("int").alias("start"), F.max("stop").alias("stop"))


def drop_repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, deleted array<int>, text) of every row: text without deleted lines."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    windows = repeated_windows(repeated_stretches(docs, min_words), min_words)
    deleted = merged(windows).groupBy("d", "t").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("runs"))
    deleted = deleted.select("d", "t", F.flatten(F.transform("runs", lambda x: F.sequence(x["start"], x["stop"]))).alias("deleted"))
    out = _key(docs).join(deleted.hint("shuffle_hash"), ["d", "t"], "left").withColumn("lines", F.split("text", "\n"))
    kept = F.expr("CASE WHEN deleted IS NULL THEN text ELSE array_join(transform(array_except(sequence(0, size(lines) - 1), deleted), i -> lines[i]), '\n') END")
    return out.select("doc_id", F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"), F.coalesce("deleted", F.expr("cast(array() AS array<int>)")).alias("deleted"), kept.alias("text"))


def op9_line_runs(docs: DataFrame) -> DataFrame:
    out = drop_repeated_runs(docs)
    return out.select("doc_id", F.greatest("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.size("deleted").cast("long").alias("n_deleted"), F.array_join(F.transform("deleted", lambda x: x.cast("string")), ",").alias("deleted_lines"), "text")
