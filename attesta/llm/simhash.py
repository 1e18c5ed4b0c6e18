"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are made in one pass over the texts. Distinct fingerprints are
then linked at ``tau`` or fewer differing bits: correlated bits are grouped
into partitions, each partition gets a threshold of its own with
``sum(t_i) = tau - m + 1`` (``-1``: not probed), chosen by dynamic programming
on candidate counts, and a pair within ``tau`` must be within ``t_i`` in one
partition at least. Each fingerprint probes the values within ``t_i`` of its
own; what it meets is verified on all 64 bits.

A value that more than ``BUCKET`` distinct fingerprints share isn't paired
up. Its members, and those that probe it, emit every fingerprint within one
bit of themselves; two fingerprints within two bits share such a midpoint, and
no midpoint has more than 65 of them, so those links are found exactly with
work in proportion to the members.

Defined results: a null or empty text, and one without words, has fingerprint
zero and is linked like any other; rows that repeat a doc_id or a text are
rows of the result each; a null doc_id never is a component's id unless all
its members' are null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from attesta.llm.common import as_long, bound_batches, signed
from attesta.llm.tokens import forget
from attesta.operators.graph import connected_components
from attesta.session import materialise, scratch_dir

#: Distinct fingerprints that share a partition's value and are paired up; beyond it, midpoints find the links.
BUCKET = 64
SHINGLE, SEED = 3, 42


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles of a whole text, A-Z in lower case, repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxh64_intdigest(b" ".join(words), seed)  # its own bits are the majority
    n = len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        some = words[at : at + (1 << 15) + shingle - 1]
        grams = map(b" ".join, zip(*(some[i:] for i in range(shingle)), strict=False))
        hashes = np.array([xxh64_intdigest(x, seed) for x in grams], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` for every row; ``fp`` is the fingerprint as a signed long."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            prints = np.fromiter((fingerprint(x) for x in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(as_long(prints))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how many have both of each two bits set; 2,080 sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            bits = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(prints)
        i, j = np.triu_indices(64)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i * 64 + j, -1), pa.int32()), pa.array(np.append(total[i, j], n).astype(np.int64))], ["pair", "n"])

    sums = {r["pair"]: r["s"] for r in distinct.select("fp").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("s")).collect()}
    both = np.zeros((64, 64))
    for pair, n in sums.items():
        if pair >= 0:
            both[pair // 64, pair % 64] = both[pair % 64, pair // 64] = n
    return sums.get(-1, 0), both


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Bits in ``m`` groups of about one size; a group takes on what correlates most with its bits."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(64)), []
    for k in range(m):
        size = len(left) // (m - k)
        first = max(left, key=lambda i: (corr[i, left].max(initial=0), -i))
        group = [first]
        left.remove(first)
        while len(group) < size:
            best = max(left, key=lambda i: (corr[i, group].mean(), -i))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, one for each partition, that sum to ``total`` at the least estimated cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, c in options.items():
                if (x := used + t) not in new or cost + c < new[x][0]:
                    new[x] = (cost + c, [*chosen, t])
        best = new
    return best[total]


def mask(bits: list[int]) -> int:
    """A group of bits as a mask in a signed long."""
    return signed(sum(1 << b for b in bits))


def plan_probes(distinct: DataFrame, tau: int, choices: tuple[int, ...] = (2, 3)) -> list[tuple[list[int], int]]:
    """Partitions and thresholds for these fingerprints: ``(bits, t)``, those with ``t = -1`` left out.

    Candidates of equal values are counted over all fingerprints; those within
    more bits are estimated from them and from each bit's own distribution.
    """
    n, both = bit_counts(distinct)
    groups = {m: group_bits(n, both, m) for m in choices if m <= tau + 1}
    flat = [(m, i, bits) for m, some in groups.items() for i, bits in enumerate(some)]
    keys = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask(bits))).alias("v")) for k, (_, _, bits) in enumerate(flat))))
    sizes = distinct.select(keys.alias("x")).groupBy("x.k", "x.v").agg(F.count("*").alias("c"))
    pairs = {r["k"]: r["s"] for r in sizes.groupBy("k").agg(F.sum(F.least(F.col("c") * (F.col("c") - 1) / 2, F.col("c") * 65.0)).alias("s")).collect()}
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p) / np.maximum(1 - 2 * p * (1 - p), 1e-9)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m, some in groups.items():
        costs = []
        for k, (mm, _, bits) in enumerate(flat):
            if mm != m:
                continue
            equal, options = float(pairs.get(k, 0)), {-1: 0.0}
            for t in range(tau + 1):
                grow = sum(float(np.sum(differ[bits]) ** j) / (1, 1, 2)[j] for j in range(t + 1))
                options[t] = sum(comb(len(bits), j) for j in range(t + 1)) * float(n) + equal * grow
            costs.append(options)
        cost, chosen = allocate(costs, tau - m + 1)
        if best is None or cost < best[0]:
            best = (cost, [(bits, t) for bits, t in zip(some, chosen, strict=True) if t >= 0])
    return best[1]


def _variants(bits: list[int], t: int) -> list[int]:
    """XORs that lead to every value within ``t`` of one in these bits."""
    out = [0]
    for _ in range(t):
        out = sorted({x ^ f for x in out for f in [0, *(1 << b for b in bits)]})
    return [signed(x) for x in out]


def _longs(values: list[int]) -> Column:
    return F.array(*(F.lit(x).cast("long") for x in values))


def links(distinct: DataFrame, probes: list[tuple[list[int], int]], tau: int, bucket: int = BUCKET) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints that connect all within ``tau`` bits (at most two)."""
    if tau > 2:
        raise ValueError("midpoints within one bit find links of two bits at most")
    index = probe = None
    for k, (bits, t) in enumerate(probes):
        own = distinct.select(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask(bits))).alias("v"), F.col("fp").alias("d"))
        index = own if index is None else index.unionByName(own)
        if t == 0:
            some = own.withColumnRenamed("d", "p")
        else:
            some = distinct.select("fp", F.explode(_longs(_variants(bits, t))).alias("x")).select(
                F.lit(k).alias("k"), F.col("fp").bitwiseXOR(F.col("x")).bitwiseAND(F.lit(mask(bits))).alias("v"), F.col("fp").alias("p"))
        probe = some if probe is None else probe.unionByName(some)
    counts = index.groupBy("k", "v").agg(F.count("*").alias("c"))
    near = F.bit_count(F.col("p").bitwiseXOR(F.col("d"))) <= tau
    if all(t == 0 for _, t in probes):  # a value with one fingerprint meets nothing
        counts = counts.where("c > 1")
    light, heavy = counts.where(F.col("c") <= bucket).select("k", "v"), counts.where(F.col("c") > bucket).select("k", "v")
    found = probe.join(index.join(light, ["k", "v"]), ["k", "v"]).where((F.col("p") < F.col("d")) & near).select(F.col("p").alias("a"), F.col("d").alias("b"))
    dense = probe.join(heavy, ["k", "v"]).select("p").unionByName(index.join(heavy, ["k", "v"]).select(F.col("d").alias("p"))).distinct()
    around = dense.select("p", F.explode(_longs([0, *(signed(1 << b) for b in range(64))])).alias("x")).select("p", F.col("p").bitwiseXOR(F.col("x")).alias("mid"))
    lowest = around.groupBy("mid").agg(F.min("p").alias("b"), F.max("p").alias("top")).where("b < top").select("mid", "b")
    stars = around.join(lowest, "mid").where("p > b").select(F.col("p").alias("a"), "b")
    return found.unionByName(stars).distinct()


def simhash_components(docs: DataFrame, tau: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)``: the smallest doc_id reachable over links of ``tau`` bits or fewer."""
    spark = docs.sparkSession
    root = scratch_dir(spark)
    prints = materialise(fingerprints(docs, id_col, text_col), f"{root}/prints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), f"{root}/distinct")
    edges = links(distinct.select("fp"), plan_probes(distinct, tau), tau)
    nodes = connected_components(edges).select(F.col("node").alias("fp"), "component")
    grouped = distinct.join(nodes, "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    lows = grouped.groupBy("component").agg(F.min("low").alias("component_id"))
    table = materialise(grouped.join(lows, "component").select("fp", "component_id"), f"{root}/components")
    return prints.join(table, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, tau: int = 2) -> DataFrame:
    """The documents, one of each group of near copies: the one with the smallest doc_id.

    Rows that share the smallest doc_id of a group all stay.
    """
    keep = simhash_components(docs, tau).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_keep")).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["_keep"]), "left_semi")
