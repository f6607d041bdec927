"""Progressive JPEG as a media column.

encode_media() stores bytes losslessly as an image: each 64 bytes are the 64 quantised coefficients
of a block (as signed numbers, in zigzag order, all quantisers 1), which is the format's own unit;
the number of bytes stands in a comment. decode_media() reads files of that or any other progressive
JPEG: coefficients by accumulating the scans, then full-resolution RGB tensors. Both are stored as
tables in the shared folder, files first and then the tensors that were read from them, these without
loss as their planes before chroma is upsampled; tensors_of() gives the RGB bytes.

Defined results: null and empty texts are stored as one block of zeros; equal texts have equal
files and features, whatever they are batched with; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscora.llm.common import written
from fiscora.llm.progressive_jpeg import Image, decode, encode, planes, rgb, rgb_of

#: Bytes that are encoded or decoded together (a longer text alone).
BUFFER = 2 << 20


def shape(n_blocks: int) -> tuple[int, int]:
    """MCUs across and down of an image with room for so many blocks, six to an MCU."""
    mcus = -(-n_blocks // 6)
    down = max(1, math.isqrt(mcus))
    return -(-mcus // down), down


def padded(text: bytes) -> bytes:
    return text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))


def to_images(texts: list[bytes]) -> list[bytes]:
    images, notes = [], []
    for text in texts:
        payload = np.frombuffer(padded(text), np.int8).reshape(-1, 64)
        across, down = shape(len(payload))
        blocks = np.zeros((6 * across * down, 64), np.int16)
        blocks[: len(payload)] = payload
        images.append((across, down, blocks))
        notes.append(f"bytes={len(text)}".encode())
    return encode(images, notes) if images else []


def payload_of(image: Image) -> tuple[int, bytes]:
    """(bytes without padding, padded bytes) that to_images() was given."""
    n = int(image.comment.removeprefix(b"bytes="))
    size, base = max(64, -(-n // 64) * 64), image.parts[0].base
    return n, image.coefs[base : base + size // 64].astype(np.int8).tobytes()


def in_pieces(items: list[bytes], most: int = BUFFER) -> Iterator[list[bytes]]:
    held, size = [], 0
    for x in items:
        if held and size + len(x) > most:
            yield held
            held, size = [], 0
        held.append(x)
        size += len(x)
    if held:
        yield held


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media) with each row's text as a progressive JPEG file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in in_pieces([x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(to_images(texts), pa.binary())], names=["doc_id", "media"])
                at += len(texts)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, media binary")


DIGESTS = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string()}
PLANES = {"height": pa.int32(), "width": pa.int32(), "factors": pa.binary(), "planes": pa.binary()}
KINDS = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}


def _kinds(fields: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{n} {KINDS[t]}" for n, t in fields.items())


def _shown(tensor: np.ndarray, whole: bool) -> dict:
    return {"feature": feature(tensor)} | ({"height": tensor.shape[0], "width": tensor.shape[1], "tensor": tensor.tobytes()} if whole else {})


def _decoded(media: DataFrame, fields: dict[str, pa.DataType], more: Callable[[Image], dict]) -> DataFrame:
    """The digests of every row of media (doc_id, media) and what more() tells of its image."""
    arrow = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for files in in_pieces(batch.column(1).to_pylist()):
                rows = []
                for doc_id, file, image in zip(batch.column(0).slice(at, len(files)).to_pylist(), files, decode(files), strict=True):
                    n, payload = payload_of(image)
                    rows.append({"doc_id": doc_id, "n_bytes": n, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]), "media_bytes": len(file), "media_sha256": hashlib.sha256(file).hexdigest()} | more(image))
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                at += len(files)

    return media.select("doc_id", "media").mapInArrow(run, _kinds(fields))


def decode_media(media: DataFrame, tensors: bool = True) -> DataFrame:
    """(doc_id, media digests, payload digests, feature and, if asked for, height, width and the RGB
    tensor's bytes) of every row of media (doc_id, media)."""
    return _decoded(media, _fields(tensors), lambda image: _shown(rgb(image), tensors))


def decode_planes(media: DataFrame) -> DataFrame:
    """As decode_media(), but with the planes that tensors_of() makes the tensors from: an image's samples
    before chroma is upsampled, half of the tensor's bytes and all that it tells."""

    def more(image: Image) -> dict:
        return dict(zip(PLANES, (image.height, image.width, *planes(image)), strict=True))

    return _decoded(media, DIGESTS | PLANES, more)


def tensors_of(stored: DataFrame, tensors: bool = True) -> DataFrame:
    """decode_media() from what decode_planes() gave: the same rows, byte by byte."""
    arrow = pa.schema(_fields(tensors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256).to_pylist()
                yield pa.RecordBatch.from_pylist([r | _shown(rgb_of(*(r[n] for n in PLANES)), tensors) for r in rows], schema=arrow)

    return stored.select(*DIGESTS, *PLANES).mapInArrow(run, _kinds(_fields(tensors)))


def _fields(tensors: bool) -> dict[str, pa.DataType]:
    return DIGESTS | {"feature": pa.string()} | ({"height": pa.int32(), "width": pa.int32(), "tensor": pa.binary()} if tensors else {})


def feature(tensor: np.ndarray) -> str:
    """Size, sums of the channels and check sum of an RGB tensor."""
    sums = tensor.reshape(-1, 3).sum(0, dtype=np.int64)
    return f"{tensor.shape[0]}x{tensor.shape[1]}:{':'.join(map(str, sums.tolist()))}:{zlib.crc32(tensor.tobytes()):08x}"


def op4_jpeg_media(docs: DataFrame) -> DataFrame:
    """Store docs as a table of files, read these back and store what they decode to as a table of
    planes; the tensors are made from that one, and the digests and features told of them."""
    media = written(encode_media(docs), "media")
    return tensors_of(written(decode_planes(media), "planes")).drop("tensor")
