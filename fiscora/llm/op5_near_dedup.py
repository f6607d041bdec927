"""MinHash near-duplicate groups with odd sketches.

1. Each text becomes its set of hashed word shingles; the set gets SAMPLES MinHash samples, keys of
   bands of these, and an odd sketch: a bitmap in which each sample flips one bit, so that the XOR
   of two sketches counts the samples that differ. Equal sets form one class.
2. Classes that share a band are joined into candidate groups: no pair of a group is listed. Bands
   are as long as lets a pair at the threshold be missed at most once in 1 / MISSED times.
3. Inside a group, pairs are compared by sketch; those that the sketch does not rule out (by 5
   standard deviations) and that are not yet connected are confirmed on the full sets. A group of
   at most BLOCK classes is done in one task. A larger one is dealt into blocks: first each block
   by itself, then each block with the first one, and last the classes outside the group's largest
   component with every block, so the rows of this last step grow with the product of a group's
   blocks and the classes outside its largest component. Only what connects parts leaves a task.
4. A class is named by its least doc_id first, so the least class of a component names it.

Defined results: without words (null, empty, white space) a document has the empty set and is
linked with nothing; fewer words than a shingle make one shingle of all of them; exact repetitions
are one class; an empty table gives an empty result; other columns are not read. Rows without an id are
linked as all others; where a component has an id at all, they are not its kept row, and else all are kept.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscora.llm.common import kept, partitions, small_batches, written
from fiscora.llm.components import components, stars

SAMPLES, BITS = 256, 1024
#: The most classes of a block, and the bytes of their sets on average.
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: The most that a pair at the threshold may be missed by all bands.
MISSED = 1e-5
#: Bytes of text that are shingled together (a longer text alone).
BUFFER = 1 << 18
#: The column of a row's own number.
ROW = "_near_dedup_row"


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over all."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@cache
def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_011)
    a, b = (rng.integers(0, 2**64, SAMPLES, np.uint64) for _ in range(2))
    return a | np.uint64(1), b, rng.integers(0, 2**64, 256, np.uint64)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    return kept(("powers", n), lambda: _made_powers(n))


def _made_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    out = []
    for x in (base, pow(base, -1, 2**64)):
        p = np.full(n, x, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    sizes = np.array([len(t) + 1 for t in texts])
    data = _LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    up, down = _powers(1 << max(19, (len(data) - 1).bit_length()))
    total = np.append(np.zeros(1, np.uint64), np.cumsum(_constants()[2][data] * up[: len(data)], dtype=np.uint64))
    gap = _SPACE[data]
    starts = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    ends = np.flatnonzero(~gap & np.r_[gap[1:], True]) + 1
    word = mix((total[ends] - total[starts]) * down[starts])
    first = np.searchsorted(starts, np.cumsum(sizes) - sizes)
    last = np.append(first[1:], len(starts))
    rolled = np.zeros(max(len(word) - k + 1, 0), np.uint64)
    for i in range(k):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + word[i : i + len(rolled)]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        else:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in word[a:b]:
                    h = h * np.uint64(0xD6E8FEB86659FD93) + w
            out.append(mix(np.array([h])) if b > a else np.zeros(0, np.uint64))
    return out


def samples_of(shingles: np.ndarray) -> np.ndarray:
    a, b, _ = _constants()
    out = np.full(SAMPLES, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = a[:, None] * shingles[None, at : at + 2048]
        part += b[:, None]
        np.minimum(out, part.min(1), out=out)
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity of the samples that fall on each bit, packed."""
    place = mix(samples + np.arange(SAMPLES, dtype=np.uint64)) % np.uint64(BITS)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=BITS) & 1).astype(np.uint8))


@cache
def band_rows(percent: int) -> int:
    """Samples of a band: as many as the threshold allows."""
    return max((r for r in range(1, 17) if (1 - (percent / 100) ** r) ** (SAMPLES // r) <= MISSED), default=1)


def band_keys(samples: np.ndarray, n_rows: int) -> np.ndarray:
    n = SAMPLES // n_rows
    rows = samples[: n * n_rows].reshape(n, n_rows)
    h = np.arange(n, dtype=np.uint64)
    for i in range(n_rows):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + rows[:, i])
    return h


def sketch_limit(similarity: float) -> int:
    """The most differing bits that a pair of this similarity has, but for five deviations."""
    differ = SAMPLES * (1 - similarity) + 5 * math.sqrt(SAMPLES * similarity * (1 - similarity))
    expected = BITS / 2 * (1 - math.exp(-4 * differ / BITS))
    return math.ceil(expected + 2 * math.sqrt(BITS) * 0.25)


def pieces(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > BUFFER:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def set_features(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, fp, sketch, bands) of docs (doc_id, text)."""
    n_rows = band_rows(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in pieces(texts):
                sizes, prints, sketches, bands = [], [], [], []
                for s in shingle_sets(texts[a:b], k):
                    sizes.append(len(s))
                    prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    m = samples_of(s) if len(s) else None
                    sketches.append(odd_sketch(m).tobytes() if len(s) else None)
                    bands.append(band_keys(m, n_rows).view(np.int64) if len(s) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(sketches, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "fp", "sketch", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, fp binary, sketch binary, bands array<long>")


class Linker:
    """Links between the rows of a task that connect what is not yet connected."""

    def __init__(self, rows: list[dict], percent: int):
        self.rows, self.percent = rows, percent
        self.sketches = np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint64).reshape(len(rows), -1)
        self.sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
        self.sizes = np.array([len(s) for s in self.sets])
        names: dict[bytes, int] = {}
        self.given = np.array([names.setdefault(r["part"], len(names)) for r in rows])
        self.names, self.part = list(names), self.given.copy()
        self.limit = sketch_limit(percent / 100)

    def similar(self, i: int, j: int) -> bool:
        both = len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))
        return 100 * both >= self.percent * (self.sizes[i] + self.sizes[j] - both)

    def connect(self) -> dict[bytes, bytes]:
        """Each given part that got connected, and the least part that it is connected with. Where
        rows have sides 0 and 1, pairs stand across; otherwise all pairs count."""
        side = np.array([r["side"] for r in self.rows])
        two = len(set(side.tolist())) > 1
        for i in range(len(self.rows)):
            others = np.flatnonzero((side == 1) & (self.part != self.part[i])) if two and side[i] == 0 else np.zeros(0, int) if two else i + 1 + np.flatnonzero(self.part[i + 1 :] != self.part[i])
            near = 100 * np.minimum(self.sizes[others], self.sizes[i]) >= self.percent * np.maximum(self.sizes[others], self.sizes[i])
            others = others[near]
            apart = np.bitwise_count(self.sketches[others] ^ self.sketches[i]).sum(1)
            keep = apart <= self.limit
            for j in others[keep][np.argsort(apart[keep], kind="stable")].tolist():
                if self.part[j] != self.part[i] and self.similar(i, j):
                    self.part[self.part == self.part[j]] = self.part[i]
        least: dict[int, bytes] = {}
        now = dict(zip(self.given.tolist(), self.part.tolist(), strict=True))
        for given, part in now.items():
            least[part] = min(least.get(part, self.names[given]), self.names[given])
        return {self.names[g]: least[p] for g, p in now.items() if least[p] != self.names[g]}


def connected(dealt: DataFrame, percent: int) -> DataFrame:
    """(a, b): part a is connected with part b < a, as each task of dealt (task, side, part, sketch,
    shingles) finds. A task has two blocks at most; its rows are held one task at a time."""
    rows = dealt.repartition(partitions(dealt.sparkSession), "task").sortWithinPartitions("task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        task = None

        def done() -> pa.RecordBatch:
            found = Linker(held, percent).connect()
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.binary())], names=["a", "b"])

        for batch in batches:
            for at in range(batch.num_rows):
                own = batch.column(0)[at].as_py()
                if held and own != task:
                    yield done()
                    held = []
                task = own
                held.append({n: batch.column(k)[at].as_py() for k, n in enumerate(batch.schema.names) if k})
        if held:
            yield done()

    return rows.select("task", "side", "part", "sketch", "shingles").mapInArrow(run, "a binary, b binary")


def _task(grp: str, i: Column, j: Column) -> Column:
    return F.xxhash64(grp, i.cast("long"), j.cast("long")).alias("task")


def node_of(rep: Column, fp: Column) -> Column:
    """Bytes that name a class, in the order of its least doc_id (a missing one is the largest)."""
    place = F.lpad(F.hex(rep.bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.concat(F.unhex(F.when(rep.isNull(), F.lit("01" + "0" * 16)).otherwise(F.concat(F.lit("00"), place))), fp)


def rep_of(node: Column) -> Column:
    """The doc_id that node_of() was given."""
    value = F.conv(F.hex(F.substring(node, 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(2**63)))
    return F.when(F.hex(F.substring(node, 1, 1)) == "00", value)


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs."""
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, k, percent, id_col, text_col)


def _near_duplicates(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    features = written(set_features(docs, k, percent), "features")
    classes = features.where("n_shingles > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"))
    classes = written(classes.withColumn("node", node_of(F.col("rep"), F.col("fp"))), "classes")
    banded = classes.select("node", F.explode("bands").alias("band"))
    hubs = written(banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("band", "hub"), "hubs")
    groups = components(banded.join(hubs, "band").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("component", "grp")
    members = written(groups.join(classes.select("node", "fp", "rep", "sketch", "n"), "node"), "members")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") * 8 / BLOCK_BYTES)).alias("blocks")
    sizes = written(members.groupBy("grp").agg(blocks), "sizes")
    members = members.join(sizes, "grp").select("node", "fp", "rep", "sketch", "grp", "blocks", F.pmod(F.xxhash64("fp"), F.col("blocks")).alias("block"))
    sets = written(_with_sets(docs, members, k), "sets")

    none = F.lit(0)
    alone = sets.select(_task("grp", F.lit(-1), F.col("block")), none.alias("side"), F.col("node").alias("part"), "sketch", "shingles")
    roots = written(connected(alone, percent), "roots")
    named = sets.select("node").join(roots, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("part"))
    large = sets.where("blocks > 1")
    if large.limit(1).count():
        large = written(large.join(roots, F.col("node") == F.col("a"), "left").withColumn("part", F.coalesce("b", "node")).drop("a", "b"), "large")
        first = large.where("block = 0").select(F.explode(F.expr("sequence(1, blocks - 1)")).alias("j"), none.alias("side"), "grp", "part", "sketch", "shingles")
        rest = large.where("block > 0").select(F.col("block").alias("j"), F.lit(1).alias("side"), "grp", "part", "sketch", "shingles")
        # Links are written first, here and below, so that no task has two Python workers at a time.
        links = connected(first.unionByName(rest).select(_task("grp", F.lit(-1), F.col("j")), "side", "part", "sketch", "shingles"), percent)
        found = stars(written(links, "links"))
        named, large = _joined(named, found), written(_joined(large, found), "parted")
        most = large.groupBy("grp", "part").count().groupBy("grp").agg(F.max(F.struct("count", "part")).alias("m"), (F.sum("count") - F.max("count")).alias("outside"))
        most = written(most.where("outside > 0").select("grp", F.col("m.part").alias("main"), F.ceil(F.col("outside") / BLOCK).alias("outer")), "most")
        if most.limit(1).count():
            large = large.join(most, "grp")
            outer = large.where("part <> main").select(F.pmod(F.xxhash64("fp"), F.col("outer")).alias("i"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("j"), none.alias("side"), "grp", "part", "sketch", "shingles")
            every = large.select(F.explode(F.expr("sequence(0, outer - 1)")).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "grp", "part", "sketch", "shingles")
            dealt = outer.unionByName(every).select(_task("grp", F.col("i"), F.col("j")), "side", "part", "sketch", "shingles")
            named = _joined(named, stars(written(connected(dealt, percent), "links")))

    named = classes.select("node", F.col("fp").alias("class")).join(named, "node", "left").select("class", rep_of(F.coalesce("part", "node")).alias("component_id"))
    out = features.select("doc_id", "n_shingles", "fp").join(written(named, "named"), F.col("fp") == F.col("class"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _joined(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with their parts replaced by what stars() has found these to be in."""
    found = found.select(F.col("node").alias("_node"), "component")
    return rows.join(found, F.col("part") == F.col("_node"), "left").withColumn("part", F.coalesce("component", "part")).select(*rows.columns)


def _with_sets(docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """members with the shingles of their first document."""
    fields = [*members.columns, "shingles"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()]
            for a, b in pieces(texts):
                sets = [s.tobytes() for s in shingle_sets(texts[a:b], k)]
                out = pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns[:-1]], pa.array(sets, pa.binary())], names=fields)
                # Rows that share a doc_id with a member but have another text are not it.
                own = [hashlib.blake2b(s, digest_size=16).digest() == fp for s, fp in zip(sets, out.column("fp").to_pylist(), strict=True)]
                yield out.filter(pa.array(own))

    def nameless(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(0).cast(pa.binary()).to_pylist()]
            for a, b in pieces(texts):
                sets = [s.tobytes() for s in shingle_sets(texts[a:b], k)]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["own", "shingles"])

    joined = docs.join(members, docs["doc_id"] == members["rep"]).select(*[members[c] for c in members.columns], "text")
    found = joined.mapInArrow(run, f"{kinds}, shingles binary").dropDuplicates(["fp"])
    lost = members.where("rep IS NULL")
    if lost.limit(1).count():  # classes of rows without ids are known by their sets alone
        sets = docs.where("doc_id IS NULL").select("text").mapInArrow(nameless, "own binary, shingles binary").dropDuplicates(["own"])
        found = found.unionByName(lost.join(sets, F.col("fp") == F.col("own")).select(*fields))
    return found


def op5_near_dedup(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"))


def first_of_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group, that of the smallest doc_id (a missing one is the largest);
    all columns stay. Rows are told apart by a number of their own, so ids may repeat or be missing."""
    keyed = written(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    groups = near_duplicates(keyed, k, percent, id_col=ROW).select(F.col("doc_id").alias(ROW), "component_id")
    order = keyed.select(ROW, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("t"), ROW).alias("order"))
    first = groups.join(order, ROW).groupBy("component_id").agg(F.min("order").alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    return keyed.join(first, ROW, "left_semi").select(*docs.columns)
