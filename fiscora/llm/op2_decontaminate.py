"""Benchmark decontamination by a distributed positional inverted index.

1. Terms of the benchmark are counted over the corpus. A window of the benchmark (10 words, or a
   whole shorter item) is represented by its rarest terms; windows with a term that the corpus
   lacks cannot occur and are dropped.
2. The index stores, for each of these terms and each document, the list of positions
   (term, doc_id, positions), as a table in the shared folder. The key holds the document, so that
   a very frequent term is spread over all partitions.
3. Lists are intersected after subtracting each term's offset, from the rarest term on. What is
   left are the places (item, document, offset) where the item may be aligned with the document.
4. At each alignment the windows are compared word by word; hit words are counted once.

All of it is DataFrame functions. Positions stay in arrays, one row for a term and document or for
an item and document, so a passage in a third of all documents makes rows, not pairs.

Defined results: null or wordless texts have no words and no hits; a document row is judged by its
own text even where doc_ids repeat; repeated benchmark rows with one item_id count as one item, and
rows without item_id are ignored; an empty benchmark hits nothing; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscora.llm.common import if_small, lower_ascii, scratch, written

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Terms of a window whose lists are intersected.
RAREST = 2


def words(text: Column) -> Column:
    """Lower-case ASCII letters, digits and all characters beyond ASCII form words."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def build_index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Postings (term, doc_id, positions) of docs (doc_id, words), of all terms or of those given,
    stored in the shared folder."""
    placed = docs.select("doc_id", F.posexplode("words").alias("position", "term"))
    if terms is not None:
        placed = placed.join(if_small(terms), "term", "left_semi")
    lists = placed.groupBy("term", "doc_id").agg(F.array_sort(F.collect_list("position")).alias("positions"))
    path = scratch(docs.sparkSession, "postings")
    lists.sortWithinPartitions("term").write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(lists.schema).parquet(path)


def phrase_matches(index: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, doc_id, starts) of documents with all terms of a pattern at its offsets.

    patterns: (pattern, terms array<struct<term, offset>>), the rarest term first; starts are
    positions of offset 0.
    """
    first, rest = F.element_at("terms", 1), F.expr("slice(terms, 2, greatest(size(terms) - 1, 0))")
    heads = patterns.where(F.size("terms") > 0).select("pattern", first["term"].alias("term"), first["offset"].alias("offset"), rest.alias("rest"))
    begun = index.join(if_small(heads), "term").select("pattern", "doc_id", "rest", F.expr("transform(positions, p -> p - offset)").alias("starts"))
    begun = written(begun, "begun")
    alone = begun.where(F.size("rest") == 0).select("pattern", "doc_id", "starts")
    more = begun.select("pattern", "doc_id", "starts", F.size("rest").alias("n"), F.explode("rest").alias("next"))
    more = more.select("pattern", "doc_id", "starts", "n", F.col("next.term").alias("term"), F.col("next.offset").alias("offset"))
    same = [more["doc_id"].eqNullSafe(index["doc_id"]), more["term"] == index["term"]]
    lists = more.join(index, same).select("pattern", more["doc_id"], "starts", "n", F.expr("transform(positions, p -> p - offset)").alias("list"))
    joined = lists.groupBy("pattern", "doc_id").agg(F.first("starts").alias("starts"), F.first("n").alias("n"), F.collect_list("list").alias("lists"))
    met = joined.where("size(lists) >= n").select("pattern", "doc_id", F.expr("aggregate(lists, starts, (acc, x) -> array_intersect(acc, x))").alias("starts"))
    return alone.unionByName(met).where(F.size("starts") > 0)


def proximity_matches(index: DataFrame, patterns: DataFrame, slop: int) -> DataFrame:
    """(pattern, doc_id, positions) where all terms of a pattern lie within slop words of a
    position of its rarest term in the document."""
    terms = patterns.select("pattern", F.size(F.expr("array_distinct(transform(terms, t -> t.term))")).alias("n"), F.explode(F.expr("array_distinct(transform(terms, t -> t.term))")).alias("term"))
    lists = index.join(if_small(terms), "term").groupBy("pattern", "doc_id", "n").agg(F.array_sort(F.collect_list(F.struct(F.size("positions").alias("size"), "term", "positions"))).alias("lists"))
    near = F.expr(f"filter(lists[0].positions, p -> forall(lists, l -> exists(l.positions, q -> abs(q - p) <= {slop})))")
    return lists.where("size(lists) = n").select("pattern", "doc_id", near.alias("positions")).where(F.size("positions") > 0)


def window_patterns(items: DataFrame, counts: DataFrame, window: int, rarest: int) -> DataFrame:
    """(item_id, pattern, terms) for the windows of items (item_id, words), by counts (term, n)."""
    starts = F.expr(f"sequence(0, greatest(size(words) - {window}, 0))")
    windows = items.where(F.size("words") > 0).select("item_id", "key", "words", F.explode(starts).alias("s"))
    placed = windows.select("item_id", "key", "s", F.posexplode(F.expr(f"slice(words, s + 1, {window})")).alias("i", "term"))
    ranked = placed.join(counts, "term", "left").groupBy("item_id", "key", "s").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), (F.col("s") + F.col("i")).alias("offset"), "term"))).alias("by"))
    best = ranked.where("by[0].n > 0").select("item_id", "key", F.expr(f"transform(slice(by, 1, {rarest}), t -> struct(t.term AS term, t.offset AS offset))").alias("terms"))
    return best.distinct().withColumn("pattern", F.xxhash64("key", F.to_json("terms")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, rarest: int = RAREST, id_col: str = "doc_id", text_col: str = "text", rest: Column | None = None) -> DataFrame:
    """docs' ids and texts with n_words, hit positions and item_ids found in each; rest, a struct of
    other columns, goes with its row where it is given."""
    carried = [] if rest is None else ["rest"]
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([] if rest is None else [rest.alias("rest")]))
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", words(F.col("text")).alias("words")).distinct()
    items = written(items.withColumn("key", F.xxhash64("item_id", "words")), "items")
    tokenised = docs.select("doc_id", words(F.col("text")).alias("words"))
    vocabulary = written(items.select(F.explode("words").alias("term")).distinct(), "vocabulary")
    counts = tokenised.select(F.explode("words").alias("term")).join(if_small(vocabulary), "term").groupBy("term").agg(F.count("*").alias("n"))
    patterns = written(window_patterns(items, written(counts, "counts"), window, rarest), "patterns")
    seeds = written(patterns.select(F.explode("terms.term").alias("term")).distinct(), "seeds")
    index = build_index(tokenised, seeds)
    places = phrase_matches(index, patterns.select("pattern", "terms"))
    keyed = places.join(if_small(patterns.select("pattern", "key", "item_id")), "pattern")
    aligned = keyed.groupBy("doc_id", "item_id", "key").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
    aligned = aligned.join(if_small(items.select("key", F.col("words").alias("item"))), "key")
    found = aligned.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "starts", "item")).alias("found"))
    found = found.hint("shuffle_hash").withColumnRenamed("doc_id", "found_id")
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found["found_id"]), "left").select("doc_id", "text", words(F.col("text")).alias("words"), "found", *carried)
    occurring = F.expr(f"""transform(coalesce(found, array()), f -> struct(f.item_id AS item_id, array_distinct(flatten(transform(f.starts, d ->
        flatten(transform(filter(sequence(0, greatest(size(f.item) - {window}, 0)), s -> CASE WHEN d + s < 0 THEN false ELSE slice(words, d + s + 1, {window} + least(0, size(f.item) - {window})) = slice(f.item, s + 1, {window}) END),
        s -> sequence(d + s, d + s + least({window}, size(f.item)) - 1)))))) AS hits))""")
    hits = joined.select("doc_id", "text", *carried, F.size("words").alias("n_words"), F.filter(occurring, lambda x: F.size(x["hits"]) > 0).alias("occurring"))
    return hits.select("doc_id", "text", *carried, "n_words", F.expr("array_distinct(flatten(occurring.hits))").alias("hit_positions"), F.expr("array_sort(array_distinct(transform(occurring.item_id, i -> cast(i AS string))))").alias("item_ids"))


def op2_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digests of decontaminate() for each document."""
    out = decontaminate(docs, benchmark)
    n_hit = F.size("hit_positions").cast("long")
    return out.select("doc_id", F.col("n_words").cast("long"), n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose own text holds a window of benchmark; all columns stay."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    judged = decontaminate(docs, benchmark, rest=F.struct(F.lit(0).alias("_decontamination_rest"), *rest)).where("size(item_ids) = 0")
    return judged.select(*[F.col(f"rest.`{c}`").alias(c) if c in rest else c for c in docs.columns])
