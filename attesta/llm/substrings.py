"""Substring dedup by relative Lempel-Ziv parsing against content-defined reference blocks.

A window is ``window`` consecutive words. Of the ``GRAM``-word grams in a
window the one with the smallest hash is its anchor; equal windows have equal
anchors, so a window whose anchor stands at one place only is unique. The
corpus is indexed by its anchors: stretches whose anchors stand at two places
or more are the blocks that can be referred to, each known by the earliest
place, (document, word), where its words stand.

Each document is parsed in two steps. A core goes from the first of a run of
such anchors to the end of its last, and refers to the earliest place of the
same words; so a long or popular passage costs one row a document. What is
left are windows at the boundaries of cores, and those of cores that stand
nowhere else as a whole: each is looked up by its words and refers to the
earliest place of the same window. Then references are followed greedily: from
each word on, the factor that stays in step with one reference for longest
counts, ``(start, length, document, place)``. Every factor's windows stand
elsewhere too, so its words go; the earliest place refers to itself.

Words are compared by 64-bit hashes, stretches of them by 128 bits; with these
results are exact. Shared keys (cores, windows) are written before rows are
joined to them, so that a key that a large share of rows has is split.

Defined results: a null or empty text has no words; words beyond ASCII white
space are unchanged; a document with fewer words than a window keeps all;
rows that repeat a doc_id are documents of their own, and repeat each other's
windows, as do rows that repeat id and text; a null doc_id is kept; of equal
references the least document counts; further columns of the input are not
looked at; very long texts are parsed whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attesta.llm.common import as_long, bound_batches
from attesta.session import materialise, release_shuffles, remove, scratch_dir

WINDOW, GRAM = 35, 8
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64((1 << 20) - 1)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: runs of anything but ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def rolling(h: np.ndarray, width: int, p: np.uint64) -> np.ndarray:
    """Hash of every run of ``width`` words, by doubling: runs of 1, 2, 4, ... are combined."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, span = None, 0, h * p, 1
    with np.errstate(over="ignore"):
        while True:
            if width & span:
                part = power[done : done + n]
                out = part.copy() if out is None else mix(out * p + part)
                done += span
            span *= 2
            if span > width:
                return out
            power = mix(power[: len(power) - span // 2] * p + power[span // 2 :])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * _P2
    return x ^ (x >> np.uint64(29))


def anchors(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """``(place, hash)``: where the anchor of each window starts, and the hashes of all grams."""
    grams = rolling(h, gram, _P1)
    width = window - gram + 1  # grams in a window
    n = len(h) - window + 1
    key = (grams & ~_LOW) | (np.arange(len(grams), dtype=np.uint64) & _LOW)  # the leftmost of equal ones
    low, span = key, 1
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[width - span : width - span + n])
    at = (low & _LOW).astype(np.int64)
    start = np.arange(n)
    at = start + ((at - start) & ((1 << 20) - 1))
    return at, grams


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of true values, ends exclusive."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _docs(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, uid, v)``; a document is known by its id (a hash of its text where that is null) and 32 bits of its text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", "text", F.coalesce("doc_id", F.xxhash64("text")).alias("uid"), F.hash("text").alias("v"))


def _index(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``(uid, anchor, vp)``: anchors of each document long enough; ``vp`` has ``v`` in its upper half and the place in its lower."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, hashes, places = [], [], []
            for uid, v, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = hash_words(words_of(text))
                if len(h) < window:
                    continue
                at, grams = anchors(h, window, gram)
                at = at[np.concatenate([[True], at[1:] != at[:-1]])]
                uids.append(np.full(len(at), uid, np.int64))
                hashes.append(as_long(grams[at]))
                places.append((v << 32) + at)
            if uids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (uids, hashes, places)], ["uid", "anchor", "vp"])

    return docs.select("uid", "v", "text").mapInArrow(run, "uid long, anchor long, vp long")


def _factor(held: DataFrame, window: int, gram: int) -> DataFrame:
    """Runs of windows whose anchors stand elsewhere too, ``(uid, v, first, last, lo, hi, core, hashes, often)``.

    Windows first..last, the core's words lo..hi and its hash, the hashes of
    the words that the run's windows cover, and how often each window's
    anchor stands in the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uid, v, text, places, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = hash_words(words_of(text))
                at, _ = anchors(h, window, gram)
                known = np.zeros(len(h), np.int32)
                known[np.array(places, np.int64)] = times
                often = known[at]
                for first, last in runs(often > 0):
                    lo, hi = int(at[first]), int(at[last - 1]) + gram
                    core = hashlib.blake2b(h[lo:hi].tobytes(), digest_size=16).digest()
                    rows.append((uid, v, first, last, lo, hi, core, h[first : last - 1 + window].tobytes(), often[first:last].tobytes()))
            if rows:
                names = ["uid", "v", "first", "last", "lo", "hi", "core", "hashes", "often"]
                kinds = [pa.int64(), *[pa.int32()] * 5, *[pa.binary()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return held.select("uid", "v", "text", "places", "times").mapInArrow(run, "uid long, v int, first int, last int, lo int, hi int, core binary, hashes binary, often binary")


def _windows(factors: DataFrame, window: int) -> DataFrame:
    """Windows to look up, ``(uid, v, start, a, b, weight)``: all of a run, or those that cross its core's bounds.

    Weight two says that a window is known to repeat: one document of those
    that share a core emits it for them all, unless its anchor stands in these
    cores alone, where nothing else can equal it.
    """
    columns = ["uid", "v", "first", "last", "lo", "hi", "copies", "chosen", "hashes", "often"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            for uid, v, first, last, lo, hi, copies, chosen, hashes, often in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = np.frombuffer(hashes, np.uint64)
                start = np.arange(first, last)
                inside = (start >= lo) & (start + window <= hi)
                whole = copies > 1
                pick = np.ones(len(start), bool)
                if whole:
                    pick = ~inside
                    if chosen:
                        pick |= np.frombuffer(often, np.int32) != copies
                if not pick.any():
                    continue
                weight = np.where(inside & whole, 2, 1)[pick]
                start = start[pick]
                a, b = rolling(h, window, _P1)[pick], rolling(h ^ _P2, window, _P2)[pick]
                same = (np.full(len(start), x, k) for x, k in ((uid, np.int64), (v, np.int32)))
                for column, x in zip(out, (*same, start.astype(np.int32), as_long(a), as_long(b), weight.astype(np.int32)), strict=True):
                    column.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["uid", "v", "start", "a", "b", "weight"])

    return factors.select(*columns).mapInArrow(run, "uid long, v int, start int, a long, b long, weight int")


def parse(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Factors ``(start, length, document, place)`` of stretches ``(start, end, document, place)`` that stand elsewhere.

    Stretches in step with one reference are one; from each word on the one
    that goes furthest counts (of equal ones that of the least document).
    """
    steps: list[list[int]] = []
    for i, j, ref, at in sorted(spans, key=lambda x: (x[2], x[3] - x[0], x[0])):
        last = steps[-1] if steps else None
        if last and last[2] == ref and last[3] == at - i and i <= last[1]:
            last[1] = max(last[1], j)
        else:
            steps.append([i, j, ref, at - i])
    steps.sort()
    out, here, k = [], 0, 0
    best: list[int] | None = None
    while True:
        while k < len(steps) and steps[k][0] <= here:
            if best is None or (steps[k][1], -steps[k][2]) > (best[1], -best[2]):
                best = steps[k]
            k += 1
        if best is not None and best[1] > here:
            out.append((here, best[1] - here, best[2], best[3] + here))
            here = best[1]
        elif k < len(steps):
            here = steps[k][0]
        else:
            return out


def _cut(held: DataFrame) -> DataFrame:
    """Each document's factors, and its text without their words."""
    factor = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref", pa.int64()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = (batch.column(i).to_pylist() for i in (1, 2))
            n, gone, kept, factors = [], [], [], []
            for text, some in zip(texts, spans, strict=True):
                words = words_of(text)
                found = parse([(x["i"], x["j"], x["ref"], x["at"]) for x in some or ()])
                stay, done = [], 0
                for start, length, _, _ in found:
                    stay += words[done:start]
                    done = start + length
                stay += words[done:]
                n.append(len(words))
                gone.append(len(words) - len(stay))
                kept.append(b" ".join(stay))
                factors.append([dict(zip(("start", "length", "ref", "at"), f, strict=True)) for f in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(factors, pa.list_(factor))],
                ["doc_id", "n_words", "n_removed", "kept", "factors"])

    return held.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, factors array<struct<start:int,length:int,ref:long,at:int>>")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept, factors)``: documents without the words that a repeated window covers.

    ``factors`` are the stretches that went: start and length in words, the
    document that they refer to, and where they stand there.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    root = scratch_dir(spark)
    numbered = _docs(docs)
    index = materialise(_index(numbered, window, gram), f"{root}/index")
    # One row for each document and anchor, so that a text that repeats itself has no more than it has anchors.
    place = F.col("vp").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    own = index.groupBy("uid", F.shiftright("vp", 32).cast("int").alias("v"), "anchor").agg(F.collect_set(place).alias("places"))
    shared = index.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", F.col("n").cast("int").alias("n"))
    shared = materialise(shared, f"{root}/shared")
    listed = own.join(shared, "anchor").select("uid", "v", F.explode("places").alias("place"), "n")
    blocks = materialise(listed.groupBy("uid", "v").agg(F.collect_list(F.struct("place", "n")).alias("x")).select("uid", "v", F.col("x.place").alias("places"), F.col("x.n").alias("times")), f"{root}/blocks")
    remove(spark, f"{root}/index")
    remove(spark, f"{root}/shared")
    release_shuffles(spark)
    factors = materialise(_factor(numbered.select("uid", "v", "text").join(blocks, ["uid", "v"]), window, gram), f"{root}/factors")
    remove(spark, f"{root}/blocks")
    release_shuffles(spark)
    at = F.struct("uid", "v", F.col("lo").alias("at"))
    cores = materialise(factors.groupBy("core").agg(F.count("*").alias("n"), F.min(at).alias("ref"), F.min(F.struct("uid", "v", "first")).alias("least")).where("n > 1"), f"{root}/cores")
    known = factors.join(cores, "core", "left").withColumn("copies", F.coalesce("n", F.lit(1)).cast("int")).withColumn("chosen", F.coalesce(F.col("least") == F.struct("uid", "v", "first"), F.lit(False)))
    checked = materialise(_windows(known, window), f"{root}/windows")
    release_shuffles(spark)
    repeated = materialise(checked.groupBy("a", "b").agg(F.sum("weight").alias("n"), F.min(F.struct("uid", "start")).alias("ref")).where("n > 1").select("a", "b", "ref"), f"{root}/repeated")
    release_shuffles(spark)
    single = checked.join(repeated, ["a", "b"]).select("uid", "v", F.struct(F.col("start").alias("i"), (F.col("start") + window).alias("j"), F.col("ref.uid").alias("ref"), F.col("ref.start").alias("at")).alias("span"))
    inside = factors.join(cores, "core").where(F.col("hi") - F.col("lo") >= window).select("uid", "v", F.struct(F.col("lo").alias("i"), F.col("hi").alias("j"), F.col("ref.uid").alias("ref"), F.col("ref.at").alias("at")).alias("span"))
    spans = materialise(single.unionByName(inside).groupBy("uid", "v").agg(F.collect_set("span").alias("spans")), f"{root}/spans")
    for name in ("windows", "repeated", "cores", "factors"):
        remove(spark, f"{root}/{name}")
    release_shuffles(spark)
    return _cut(numbered.join(spans, ["uid", "v"], "left"))
