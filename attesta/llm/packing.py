"""Packing into fixed windows: histogram of lengths, non-negative least squares, residual filling.

Each document is encoded whole and cut at multiples of the window; what is
left of it, its tail, is shorter than a window. Tails are counted in ``BINS``
length classes. Shallow combinations of classes that fill a window exactly are
enumerated, their repeat counts are solved against the histogram by
non-negative least squares and rounded down, and each combination takes tails
by their rank in their class. Tails above the planned counts are residuals:
laid end to end they fill, in order, the gaps that the planned windows have,
then windows of their own, and the last few ids go to windows whose lengths
are powers of two. So no window has padding.

Everything that grows with the corpus is distributed: ranks come from counts
per part and class, gaps and residuals are joined by position. Only the
histogram (``BINS + 1`` rows) and the plan (at most ``BINS`` combinations, as
a basic solution has no more) reach the driver.

Defined results: a null or empty text has the end id alone; rows that repeat,
or have a null doc_id, are documents of their own; an empty table gives no
pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from attesta.llm.common import bound_batches
from attesta.llm.tokens import encoder
from attesta.session import materialise, scratch_dir

WINDOW, BINS, DEPTH = 4096, 64, 4
#: Keys in a chunk of a running total; positions in a cell of the join of gaps and residuals.
CHUNK, CELL = 1 << 16, 1 << 16
ATOMS = "part int, bin int, rank long, doc_id long, start long, length int, doc_tokens long, crc long, ids binary"
FULL = -1  #: the class of a piece that fills a window


def encode_atoms(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, bins: int = BINS) -> DataFrame:
    """Whole windows and the tail of each document, with their ids and rank within part and class."""
    bound_batches(docs.sparkSession, 2048)
    width = -(-window // bins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc, ranks = TaskContext.get().partitionId(), encoder(tokenizer), {}
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            for at in range(0, len(texts), 2048):
                rows = []
                for key, ids in zip(keys[at : at + 2048], enc.encode_batch(texts[at : at + 2048], end_id), strict=True):
                    n = len(ids)
                    for start in range(0, n, window):
                        some = ids[start : start + window]
                        kind = FULL if len(some) == window else (len(some) - 1) // width
                        rank = ranks.get(kind, 0)
                        ranks[kind] = rank + 1
                        rows.append((part, kind, rank, key, start, len(some), n, zlib.crc32(some.astype("<u4").tobytes()), some.tobytes()))
                names = ["part", "bin", "rank", "doc_id", "start", "length", "doc_tokens", "crc", "ids"]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ATOMS)


def combinations(bins: int = BINS, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Multisets of at most ``depth`` classes whose upper lengths fill a window, and one class repeated."""
    found = set()
    for n in range(1, depth):
        for some in combinations_with_replacement(range(1, bins + 1), n):
            rest = bins - sum(some)
            if rest >= some[-1]:
                found.add((*(x - 1 for x in some), rest - 1))
    found.add((bins - 1,))
    found.update((b,) * (bins // (b + 1)) for b in range(bins) if bins % (b + 1) == 0)
    return sorted(found)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Non-negative x with the least ``|ax - b|``, by the active-set method of Lawson and Hanson."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[passive] = -np.inf
        j = int(np.argmax(gradient))
        if gradient[j] <= tolerance or passive.sum() >= a.shape[0]:
            break
        passive[j] = True
        while True:
            trial = np.zeros_like(x)
            trial[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            bad = passive & (trial <= 0)
            if not bad.any():
                x = trial
                break
            step = np.min(x[bad] / np.maximum(x[bad] - trial[bad], 1e-300))
            x = x + step * (trial - x)
            passive &= x > 1e-12
            x[~passive] = 0
    return x


def plan(counts: np.ndarray, tokens: int, window: int = WINDOW, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """Combinations and their repeat counts, for a histogram of classes and the ids in all tails.

    No more windows are planned than the ids fill, so that residuals can fill every gap.
    """
    columns = combinations(len(counts), depth)
    a = np.zeros((len(counts), len(columns)))
    for j, some in enumerate(columns):
        np.add.at(a[:, j], list(some), 1)
    scale = max(1.0, float(counts.max(initial=0)))
    x = np.floor(nnls(a, counts / scale) * scale + 1e-6)
    over = a @ x > counts  # a least-squares fit may overshoot a class
    while over.any():
        hit = (a[over] > 0).any(axis=0) & (x > 0)
        ratio = np.min(np.where(a @ x > 0, counts / np.maximum(a @ x, 1), 1)[over])
        x[hit] = np.minimum(np.floor(x[hit] * ratio), x[hit] - 1)
        over = a @ x > counts
    most = tokens // window
    if x.sum() > most:
        x = np.floor(x * (most / x.sum()))
    return [(columns[j], int(x[j])) for j in np.flatnonzero(x > 0)]


def running_total(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over all smaller keys; keys are dense and unique, and summed in chunks."""
    chunked = df.withColumn("_chunk", F.floor(F.col(key) / CHUNK))
    sums = chunked.groupBy("_chunk").agg(F.sum(value).alias("_sum"))
    bases = sums.select("_chunk", (F.sum("_sum").over(Window.orderBy("_chunk")) - F.col("_sum")).alias("_base"))
    within = F.sum(value).over(Window.partitionBy("_chunk").orderBy(key)) - F.col(value)
    return chunked.withColumn("_within", within).join(bases, "_chunk").withColumn(out, F.col("_base") + F.col("_within")).drop("_chunk", "_base", "_within")


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, bins: int = BINS, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """Pieces in their sequences, and the atoms that hold their ids.

    A piece has ``part, bin, rank`` of its atom, ``low`` (where it starts in
    it), doc_id, start, length, doc_tokens, sequence_id, offset and ids_crc32.
    """
    spark, root = docs.sparkSession, scratch_dir(docs.sparkSession)
    atoms = materialise(encode_atoms(docs, tokenizer, end_id, window, bins), f"{root}/atoms")
    light = atoms.drop("ids")
    counts = materialise(light.groupBy("part", "bin").agg(F.count("*").alias("n"), F.sum("length").alias("tokens")), f"{root}/counts")
    histogram = {r["bin"]: (r["n"], r["tokens"]) for r in counts.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).collect()}
    full = histogram.pop(FULL, (0, 0))[0]
    tails = np.array([histogram.get(b, (0, 0))[0] for b in range(bins)], np.int64)
    tokens = sum(t for _, t in histogram.values())
    chosen = plan(tails, tokens, window, depth)

    # Slots: in each class, ranks below the planned count go to (first sequence, slot) by arithmetic.
    slots: dict[int, list[tuple[int, int, int, int]]] = {b: [] for b in range(bins)}
    planned, first = np.zeros(bins, np.int64), full
    for some, repeats in chosen:
        for slot, b in enumerate(some):
            slots[b].append((int(planned[b]), int(planned[b]) + repeats, first, slot))
            planned[b] += repeats
        first += repeats
    residual_base = np.concatenate([[0], np.cumsum(tails - planned)])[:-1]
    rows = [(b, lo, hi, seq - lo, slot) for b, some in slots.items() for lo, hi, seq, slot in some]
    rows += [(b, int(planned[b]), int(tails[b]), None, int(residual_base[b] - planned[b])) for b in range(bins) if tails[b] > planned[b]]
    rows += [(FULL, 0, full, 0, 0)] if full else []
    table = spark.createDataFrame(rows, "bin int, lo long, hi long, shift long, slot long")  # a few hundred rows at most
    before = Window.partitionBy("bin").orderBy("part")
    offsets = counts.select("part", "bin", (F.sum("n").over(before) - F.col("n")).alias("base"))
    placed = (
        light.join(offsets, ["part", "bin"]).withColumn("place", F.col("base") + F.col("rank"))
        .join(F.broadcast(table.withColumnRenamed("bin", "_bin")), (F.col("bin") == F.col("_bin")) & (F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi")))
        .select("part", "bin", "rank", "doc_id", "start", "length", "doc_tokens", "crc", (F.col("place") + F.col("shift")).alias("sequence_id"),
                F.col("slot"), (F.col("place") + F.col("slot")).alias("residual"))
    )
    placed = materialise(placed, f"{root}/placed")
    whole = placed.where(F.col("sequence_id").isNotNull())
    in_order = Window.partitionBy("sequence_id").orderBy("slot")
    pieces = whole.withColumn("offset", F.sum("length").over(in_order) - F.col("length")).select(
        "part", "bin", "rank", F.lit(0).cast("long").alias("low"), "doc_id", "start", F.col("length").cast("long").alias("length"), "doc_tokens", "sequence_id", "offset", F.col("crc").alias("ids_crc32"))

    # The line of gaps, then whole windows, then windows of powers of two; the residuals fill it end to end.
    used = whole.where(f"bin <> {FULL}").groupBy("sequence_id").agg(F.sum("length").alias("used")).where(F.col("used") < window)
    gaps = used.select((F.col("sequence_id") - full).alias("key"), "sequence_id", F.col("used").alias("base"), (F.lit(window) - F.col("used")).alias("size"))
    n_windows = first - full
    left = tokens - n_windows * window
    extra, rest = divmod(left, window)
    last = [(n_windows + extra + i, first + extra + i, 0, 1 << b) for i, b in enumerate(b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1)]
    more = spark.range(extra).select((F.col("id") + n_windows).alias("key"), (F.col("id") + first).alias("sequence_id"), F.lit(0).cast("long").alias("base"), F.lit(window).cast("long").alias("size"))
    line = gaps.unionByName(more).unionByName(spark.createDataFrame(last, "key long, sequence_id long, base long, size long"))
    line = running_total(line, "key", "size", "lo").withColumn("hi", F.col("lo") + F.col("size"))
    rest_rows = placed.where(F.col("sequence_id").isNull())
    fillers = running_total(rest_rows.withColumn("size", F.col("length").cast("long")), "residual", "size", "f_lo").withColumn("f_hi", F.col("f_lo") + F.col("size"))
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / CELL), F.floor((F.col(hi) - 1) / CELL)))
    a = line.select("sequence_id", "base", "lo", "hi", cells("lo", "hi").alias("cell"))
    b = fillers.drop("sequence_id").select("part", "bin", "rank", "doc_id", "start", "doc_tokens", "f_lo", "f_hi", cells("f_lo", "f_hi").alias("cell"))
    low, high = F.greatest("lo", "f_lo"), F.least("hi", "f_hi")
    cut = (
        a.join(b, "cell").where((low < high) & (F.floor(low / CELL) == F.col("cell")))
        .select("part", "bin", "rank", (low - F.col("f_lo")).alias("low"), "doc_id", (F.col("start") + low - F.col("f_lo")).alias("start"), (high - low).alias("length"),
                "doc_tokens", "sequence_id", (F.col("base") + low - F.col("lo")).alias("offset"))
    )
    # Ranks go up with the part, so each class has one place from which on its atoms are residuals.
    edges = {r["bin"]: (r["part"], int(planned[r["bin"]]) - r["base"]) for r in offsets.join(counts, ["part", "bin"]).where(f"bin <> {FULL}").join(
        F.broadcast(spark.createDataFrame([(b, int(planned[b])) for b in range(bins)], "bin int, planned long")), "bin").where("planned >= base and planned < base + n").collect()}
    if not edges:
        return pieces, atoms
    part_of, rank_of = (F.create_map(*(F.lit(x) for b, edge in sorted(edges.items()) for x in (b, edge[i]))) for i in range(2))
    held = atoms.where(F.col("bin").isin(*edges) & ((F.col("part") > part_of[F.col("bin")]) | ((F.col("part") == part_of[F.col("bin")]) & (F.col("rank") >= rank_of[F.col("bin")]))))
    return pieces.unionByName(_with_crc(cut, held, tokenizer)), atoms


def _with_crc(cut: DataFrame, atoms: DataFrame, tokenizer: str) -> DataFrame:
    """Add ids_crc32 to pieces of residual atoms, from their ids."""
    kinds = ", ".join(f"{k} {t}" for k, t in cut.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(tokenizer).dtype
        for batch in batches:
            low, length, ids = (batch.column(x).to_pylist() for x in ("low", "length", "ids"))
            crcs = [zlib.crc32(np.frombuffer(x, dtype)[i : i + n].astype("<u4").tobytes()) for x, i, n in zip(ids, low, length, strict=True)]
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(crcs, pa.int64())], [*names, "ids_crc32"])

    keys = ["part", "bin", "rank"]
    joined = cut.join(atoms.select(*keys, "ids"), keys).select(*cut.columns, "ids")
    return joined.mapInArrow(run, f"{kinds}, ids_crc32 long")


def sequences(pieces: DataFrame, atoms: DataFrame, tokenizer: str) -> DataFrame:
    """The packed sequences themselves: ``(sequence_id, length, ids)``, ids as little-endian u32, for training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(tokenizer).dtype
        for batch in batches:
            seqs, parts = (batch.column(i).to_pylist() for i in range(2))
            out = [b"".join(np.frombuffer(p["ids"], dtype)[p["low"] : p["low"] + p["length"]].astype("<u4").tobytes() for p in some) for some in parts]
            yield pa.RecordBatch.from_pydict({"sequence_id": pa.array(seqs, pa.int64()), "length": pa.array([len(x) // 4 for x in out], pa.int64()), "ids": pa.array(out, pa.binary())})

    keys = ["part", "bin", "rank"]
    rows = pieces.join(atoms.select(*keys, "ids"), keys).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "low", "length", "ids"))).alias("pieces"))
    return rows.mapInArrow(run, "sequence_id long, length long, ids binary")  # a window has few pieces: none is empty
