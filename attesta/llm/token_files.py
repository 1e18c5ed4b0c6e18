"""Token-ID output: fixed-width bit packing with block offsets.

An *image* is a self-describing binary file of whole documents in ascending
order of ``doc_id``. Every id takes the minimum number of bits of the
vocabulary; ids are packed in blocks that start at byte boundaries listed in
the header, so any range of ids is unpacked with numpy from its own blocks.
Images are rows of a Parquet table in the shared folder, the container that
any store Spark reaches can hold and that a lost executor's retry rewrites
whole; ``image`` alone is the file format and may be saved as it is.

Layout, little-endian: magic ``ATPK``; version, bits (u8), pad (u16);
n_docs, n_ids (u64); ids per block, n_blocks (u32); byte offset of each block
and of the end (u64); validity of each doc_id (u8); doc_id (i64); first id of
each document and the end (u64); payload.

Defined results: a null text is empty (the end id alone); a null doc_id sorts
first; rows that repeat a doc_id stand in the order of their texts' hash and
are documents of their own; an empty table gives no images and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attesta.llm.common import bound_batches
from attesta.llm.tokens import encoder
from attesta.session import materialise, scratch_dir

MAGIC = b"ATPK"
HEAD = struct.Struct("<4sBBHQQII")
#: Ids in an image, unless one document has more; ids in a block (a multiple of 8).
IMAGE_IDS, BLOCK_IDS = 1 << 16, 1 << 12
SHARDS = "part int, n_docs long, n_ids long, start_in_part long, image binary"


def bit_width(vocab: int) -> int:
    """Bits that hold every id of a vocabulary."""
    return max(1, (max(1, vocab) - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive ``bits``-bit numbers, low bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(wide, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes()


def unpack_bits(data, n: int, bits: int) -> np.ndarray:
    """The ``n`` ids that :func:`pack_bits` packed."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def write_image(doc_ids: list[int | None], arrays: list[np.ndarray], bits: int) -> bytes:
    """One image of whole documents."""
    starts = np.zeros(len(arrays) + 1, "<u8")
    np.cumsum([len(x) for x in arrays], out=starts[1:])
    n = int(starts[-1])
    ids = np.concatenate(arrays) if arrays else np.zeros(0, "<u4")
    blocks = [pack_bits(ids[i : i + BLOCK_IDS], bits) for i in range(0, n, BLOCK_IDS)]
    offsets = np.zeros(len(blocks) + 1, "<u8")
    np.cumsum([len(x) for x in blocks], out=offsets[1:])
    valid = np.array([x is not None for x in doc_ids], np.uint8)
    keys = np.array([x or 0 for x in doc_ids], "<i8")
    return b"".join([HEAD.pack(MAGIC, 1, bits, 0, len(arrays), n, BLOCK_IDS, len(blocks)), offsets.tobytes(), valid.tobytes(), keys.tobytes(), starts.tobytes(), *blocks])


class Image:
    """Random access to an image."""

    def __init__(self, data: bytes):
        magic, version, self.bits, _, n, self.n_ids, self.block, blocks = HEAD.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not an image of token ids")
        self.data, at = memoryview(data), HEAD.size
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at)
        at += 8 * (blocks + 1)
        self.valid = np.frombuffer(data, np.uint8, n, at)
        self.doc_ids = np.frombuffer(data, "<i8", n, at + n)
        self.starts = np.frombuffer(data, "<u8", n + 1, at + 9 * n)
        self.payload = at + 9 * n + 8 * (n + 1)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids of a range, unpacked from the blocks that hold it."""
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        low, high = self.payload + int(self.offsets[first]), self.payload + int(self.offsets[last + 1])
        n = min(self.n_ids, (last + 1) * self.block) - first * self.block
        return unpack_bits(self.data[low:high], n, self.bits)[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document."""
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and write images to ``path``; returns the written table.

    One range shuffle puts the documents in order; texts move once, ids never.
    """
    bound_batches(docs.sparkSession, 2048)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done, keys, held = TaskContext.get().partitionId(), 0, [], []
        enc = encoder(tokenizer)
        bits = bit_width(max(enc.vocab, end_id + 1))

        def image() -> pa.RecordBatch:
            nonlocal done
            n = sum(map(len, held))
            row = {"part": [part], "n_docs": [len(held)], "n_ids": [n], "start_in_part": [done], "image": [write_image(keys, held, bits)]}
            done += n
            keys.clear()
            held.clear()
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("start_in_part", pa.int64()), ("image", pa.binary())]))

        size = 0
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for key, ids in zip(batch.column(0).to_pylist(), enc.encode_batch(texts, end_id), strict=True):
                keys.append(key)
                held.append(ids)
                size += len(ids)
                if size >= IMAGE_IDS:
                    yield image()
                    size = 0
        if held:
            yield image()

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("x"))
    return materialise(rows.repartitionByRange("k").sortWithinPartitions(F.col("k"), F.xxhash64("x")).mapInArrow(encode, SHARDS), path)


def read_token_files(shards: DataFrame, with_ids: bool = True) -> DataFrame:
    """Per document, read back from the images: doc_id, start, n_tokens, ids_crc32, ids (u32, little-endian, if asked for).

    The first id of each part is its predecessors' sum; the driver adds up one
    number for each part (no more than the shuffle partitions of the writer).
    """
    spark = shards.sparkSession
    base, bases = 0, []
    for part, n in sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        bases.append((part, base))
        base += n
    table = spark.createDataFrame(bases, "part int, base long")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                image = Image(data)
                ids, starts = image.ids(0, image.n_ids), image.starts.astype(np.int64)
                docs = [ids[i:j].tobytes() for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                columns = {
                    "doc_id": pa.array(image.doc_ids, pa.int64(), mask=image.valid == 0),
                    "start": pa.array(first + starts[:-1], pa.int64()),
                    "n_tokens": pa.array(np.diff(starts), pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in docs], pa.int64()),
                }
                yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(docs, pa.binary())} if with_ids else {}))

    rows = shards.join(F.broadcast(table), "part").select((F.col("base") + F.col("start_in_part")).alias("first"), "image")
    return rows.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def token_output(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Write ``docs`` as token files and read them back."""
    path = path or f"{scratch_dir(docs.sparkSession)}/tokens"
    return read_token_files(write_token_files(docs, path, tokenizer, end_id), with_ids)
