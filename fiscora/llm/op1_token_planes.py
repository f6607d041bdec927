"""Token-ID output in byte planes.

Documents are range-partitioned by doc_id, so that partition order is document order. Each
partition (a *shard*) tokenises its documents and groups whole documents into *chunks*. A chunk's
ids are cut into fixed-size blocks; each block of n ids is transposed into `width` byte planes
(plane k holds byte k of every id) and each plane is compressed with zstandard. A chunk is one row
of a Parquet dataset, written by Spark's own committer, so that any store Spark can write works and
a lost or repeated task leaves no half file. The chunk index (shard, chunk, place of its first id,
documents, block and plane sizes) is a second, small dataset.

Defined results: a null text is an empty document, which holds the end id alone; an empty table
makes an empty dataset; documents with the same doc_id keep all their rows, ordered by text;
columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fiscora.llm.common import kept, partitions, scratch

BLOCK_IDS = 65_536
CHUNK_IDS = 1_048_576
#: Distinct pieces whose ids a worker remembers, in each of two generations: about 120 MB each at most.
REMEMBERED = 600_000
#: Characters of texts that are encoded together (a longer text alone).
TOGETHER = 1 << 12
#: Signs that may stand behind a word (an apostrophe may begin a token with letters).
SIGNS = ".,;:!?*#%$&()[]{}<>/=+-_~^|@\""
#: White space other than the space, in ASCII and beyond.
GAPS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
WIDE_GAPS = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

CHUNK_SCHEMA = (
    "shard int, chunk int, first_id long, n_ids long, block_ids int, width int, "
    "doc_ids array<long>, n_tokens array<int>, planes array<binary>"
)


class PieceEncoder:
    """Ids of texts by the tokenizers library, remembered by piece.

    A byte-level pre-tokenizer always ends a token before a lone space between two other
    characters, so a text cut there has the ids of its pieces, one after the other. Unknown pieces
    of a text are encoded together and told apart by the bytes that their tokens stand for; a known
    word with signs behind it needs no encoding, as letters and signs never share a token. Texts
    with a space beside other white space, and texts with special tokens, are encoded whole.
    """

    def __init__(self, path: str, end_id: int, most: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        #: Ids of what follows a space, in two generations.
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.few: dict[str, bytes] = {}
        self.end = np.array([end_id], "<u4").tobytes()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # a byte-level token has one character for each byte
            self.bytes_of[i] = len(token)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def alone(self, text: str) -> bytes:
        """Ids of a row of signs, or of a text's first piece."""
        if (ids := self.few.get(text)) is None:
            if len(self.few) > 20_000:
                self.few.clear()
            ids = self.few[text] = self.whole(text)
        return ids

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids of pieces."""
        new = pieces
        if self.old:
            new = pieces.difference(self.old)
            for p in pieces.difference(new):
                self.known[p] = self.old[p]
        known, others = self.known, []
        for p in new:
            core = p.rstrip(SIGNS)
            if len(core) < len(p) and (ids := known.get(core)) and core[-1].isalpha():
                known[p] = ids + self.alone(p[len(core) :])
            else:
                others.append(p)
        if not others:
            return
        ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(others)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum([1 + len(p.encode()) for p in others])) + 1
        raw, at = ids.tobytes(), 0
        for p, end in zip(others, (4 * ends).tolist(), strict=True):
            known[p], at = raw[at:end], end

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, with the end id."""
        out, cut = [self.end] * len(texts), []
        if len(self.known) > self.most:
            self.known, self.old = {}, self.known
        for i, text in enumerate(texts):
            if text:
                head, gap, rest = text.partition(" ")
                if not gap or text[0].isspace() or text[-1].isspace() or crowded(text) or any(x in text for x in self.special):
                    out[i] = self.whole(text) + self.end
                else:
                    cut.append((i, head, rest.split(" ")))
        if new := set().union(*[pieces for _, _, pieces in cut]).difference(self.known):
            self.learn(new)
        for i, head, pieces in cut:
            out[i] = b"".join([self.alone(head), *map(self.known.__getitem__, pieces), self.end])
        return out


def encoded(encoder: PieceEncoder, texts: pa.Array) -> Iterator[bytes]:
    """The ids of each text, a few texts at a time."""
    held, size = [], 0
    for text in texts:
        held.append(text.as_py())
        size += len(held[-1] or "")
        if size >= TOGETHER:
            yield from encoder.encode(held)
            held, size = [], 0
    yield from encoder.encode(held)


def crowded(text: str) -> bool:
    """Whether a space stands beside other white space."""
    return "  " in text or any(g in text and (f" {g}" in text or f"{g} " in text) for g in (GAPS if text.isascii() else GAPS + WIDE_GAPS))


def piece_encoder(path: str, end_id: int) -> PieceEncoder:
    """One for all tasks of a worker: what it has learnt stays."""
    return kept(("pieces", path, end_id), lambda: PieceEncoder(path, end_id))


def to_planes(ids: np.ndarray, width: int, block_ids: int, press: zstandard.ZstdCompressor) -> list[bytes]:
    """Compressed planes, block by block."""
    out = []
    for at in range(0, len(ids), block_ids):
        block = np.ascontiguousarray(ids[at : at + block_ids], "<u4").view(np.uint8).reshape(-1, 4)
        if block[:, width:].any():
            raise ValueError(f"an id needs more than {width} bytes")
        out += [press.compress(np.ascontiguousarray(block[:, k]).tobytes()) for k in range(width)]
    return out


def from_planes(planes: list[bytes], n_ids: int, width: int, block_ids: int, expand: zstandard.ZstdDecompressor) -> np.ndarray:
    """The ids that to_planes() was given."""
    out = np.zeros((n_ids, 4), np.uint8)
    for b, at in enumerate(range(0, n_ids, block_ids)):
        for k in range(width):
            plane = np.frombuffer(expand.decompress(planes[b * width + k]), np.uint8)
            out[at : at + block_ids, k] = plane
    return out.view("<u4").reshape(-1)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, width: int = 2, block_ids: int = BLOCK_IDS, chunk_ids: int = CHUNK_IDS, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> None:
    """Write the chunks of docs to path/chunks and their index to path/index."""
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, chunk, first = TaskContext.get().partitionId(), 0, 0
        encoder, press = piece_encoder(tokenizer, end_id), zstandard.ZstdCompressor(level=1)
        names, parts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            row = {"shard": shard, "chunk": chunk, "first_id": first, "n_ids": len(ids), "block_ids": block_ids, "width": width, "doc_ids": names, "n_tokens": [len(p) // 4 for p in parts], "planes": to_planes(ids, width, block_ids, press)}
            return pa.RecordBatch.from_pylist([row], schema=CHUNK_ARROW)

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(encoder, batch.column(1)), strict=True):
                if parts and held + len(ids) // 4 > chunk_ids:
                    yield flush()
                    chunk, first, names, parts, held = chunk + 1, first + held, [], [], 0
                names.append(doc_id)
                parts.append(ids)
                held += len(ids) // 4
        if parts:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(shards or partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, CHUNK_SCHEMA).write.option("compression", "none").parquet(f"{path}/chunks")
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks")
    index = chunks.select("shard", "chunk", "first_id", "n_ids", F.size("doc_ids").alias("n_docs"), F.transform("planes", F.length).alias("plane_bytes"))
    index.coalesce(8).write.parquet(f"{path}/index")


CHUNK_ARROW = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("block_ids", pa.int32()), ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())), ("planes", pa.list_(pa.binary()))])


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of every document in the files at path."""
    schema = "doc_id long, shard int, local_start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    fields = [("doc_id", pa.int64()), ("shard", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    arrow = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(n)[at] for n in batch.schema.names}
                n_ids = row["n_ids"].as_py()
                ids = from_planes(row["planes"].as_py(), n_ids, row["width"].as_py(), row["block_ids"].as_py(), expand)
                counts = row["n_tokens"].values.to_numpy()
                ends = np.cumsum(counts, dtype=np.int64)
                starts, raw = ends - counts, memoryview(ids.tobytes())
                columns = [row["doc_ids"].values, pa.array(np.full(len(counts), row["shard"].as_py(), np.int32)), pa.array(starts + row["first_id"].as_py()), pa.array(counts.astype(np.int64)), pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, n_ids).astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks")
    found = chunks.mapInArrow(decode, schema).join(F.broadcast(shard_offsets(spark, path)), "shard")
    out = ["doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"]
    return found.select(*out, *["ids"] * with_ids)


def shard_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(shard, offset): the ids before each shard, by the index. One row a shard: a bounded number,
    whatever the corpus."""
    shards = spark.read.parquet(f"{path}/index").groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))


def read_range(spark: SparkSession, path: str, start: int, n: int) -> DataFrame:
    """(start, ids): the ids from place `start` on, n at most, one row for each chunk that has some of
    them. The index tells these chunks; no other one is decoded."""
    index = spark.read.parquet(f"{path}/index").join(F.broadcast(shard_offsets(spark, path)), "shard")
    first = F.col("offset") + F.col("first_id")
    hit = index.select("shard", "chunk", first.alias("start"), "n_ids").where((F.col("start") < start + n) & (F.col("start") + F.col("n_ids") > start))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                ids = from_planes(row["planes"], row["n_ids"], row["width"], row["block_ids"], expand)
                a, b = max(start - row["start"], 0), min(start + n - row["start"], row["n_ids"])
                yield pa.RecordBatch.from_arrays([pa.array([row["start"] + a], pa.int64()), pa.array([ids[a:b].astype(np.int64)], pa.list_(pa.int64()))], names=["start", "ids"])

    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks").join(hit.drop("n_ids"), ["shard", "chunk"])
    return chunks.select("start", "n_ids", "width", "block_ids", "planes").mapInArrow(decode, "start long, ids array<long>")


def op1_token_planes(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write docs as token files in the shared folder, read them back, and return the digests."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path("byte_bpe_50k.json"))
    path = scratch(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id=2)
    return read_tokens(spark, path, with_ids=False)
