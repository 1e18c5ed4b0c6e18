"""Near copies by the Jaccard similarity of five-word shingles.

Candidates come first from SimHash: texts of one fingerprint of their shingles,
and those whose fingerprints differ by ``TAU`` bits, linked by the generalised
pigeonhole principle as in :mod:`attesta.llm.simhash`. Similar texts may differ
in more bits than can be probed, so MinHash finds the rest: ``BANDS`` keys of ``ROWS`` minima each, so that a
pair of similarity 0.8 shares a key but for 7 in a million. All members of a
key are first compared with one of them, the one whose keys most texts share.
Where links don't connect what shares keys, directly or through others, those
texts are compared with each other, all with all, in blocks of a bounded number
of texts and shingles: a block gives a spanning forest of its links, never its
pairs. Every link is verified on all shingles of both texts, so none is below
the threshold.

Defined results: words stand between white space, A-Z in lower case; a text of
fewer than five words is one shingle, texts without words equal each other; a
null text is an empty one; equal texts are one node; rows that repeat are rows
of the result each; a null doc_id is a component's id only if all its members'
are null; further columns are carried along whatever their names; very long
texts are compared whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attesta.llm import simhash
from attesta.llm.common import as_long, bound_batches
from attesta.llm.embeddings import _forest
from attesta.llm.tokens import forget
from attesta.operators.graph import connected_components
from attesta.session import materialise, release_shuffles, remove, scratch_dir

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS = 30, 5
#: Bits in which the fingerprints of candidates may differ.
TAU = 2
#: Edges up to which a graph of texts is contracted in one task.
FEW_EDGES = 200_000
#: Texts, and shingles, of a block of texts that are compared all with all.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
_RANDOM = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, (3, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct word shingles of a text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = set(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))) or {b" ".join(words)}
    return np.fromiter((xxh64_intdigest(x, SEED) for x in grams), np.uint64, len(grams))


def bands(hashes: np.ndarray) -> np.ndarray:
    """Keys that similar sets of hashes are likely to share."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 1 << 12):
            low = np.minimum(low, ((hashes[at : at + (1 << 12), None] ^ _RANDOM[0]) * _RANDOM[1]).min(axis=0))
        return (low * _RANDOM[2]).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of a text's shingles, as one number: a bit is set if over half the hashes have it."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)


def keys_of(text: str | None) -> np.ndarray:
    """The MinHash keys of a text, and its fingerprint last."""
    hashes = shingles(text)
    return np.concatenate([bands(hashes), fingerprint(hashes)])


def close_prints(nodes: DataFrame, root: str) -> DataFrame:
    """Pairs ``(a, b)`` of texts that connect those whose fingerprints differ by ``TAU`` bits or fewer; ``nodes`` has th and fp."""
    prints = materialise(nodes.groupBy("fp").agg(F.min("th").alias("first")), f"{root}/prints")
    links = simhash.links(prints.select("fp"), simhash.plan_probes(prints, TAU), TAU)
    one, two = (prints.select(F.col("fp").alias(x), F.col("first").alias(f"t{x}")) for x in "ab")
    apart = links.join(one, "a").join(two, "b").select("ta", "tb")
    same = nodes.join(prints, "fp").where("th <> first").select(F.col("th").alias("ta"), F.col("first").alias("tb"))
    return apart.unionByName(same).select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))


def _mapped(rows: DataFrame, make, name: str) -> DataFrame:
    """``rows`` (longs, ``text`` last) with an array of longs made from the text in its place."""
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            made = [as_long(make(x)) for x in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.list_(pa.int64()))], [*names, name])

    return rows.mapInArrow(run, "".join(f"{x} long, " for x in names) + f"{name} array<long>")


def similar(pairs: DataFrame, sets: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Those of the pairs ``(a, b)`` of text hashes that are similar enough; ``sets`` has ``th`` and its shingles ``s``."""
    one, two = (sets.select(F.col("th").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    met = pairs.join(one, "a").join(two, "b")
    both, total = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
    return met.where((total == 0) | (both >= F.lit(threshold) * (total - both))).select("a", "b")


def shared_shingles(a: list[np.ndarray], b: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many shingles each text of one list has in common with each of the other."""
    both = a + b
    _, code, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1  # a shingle of one text is shared with none
    owner = np.repeat(np.arange(len(both)), [len(x) for x in both])
    use = count[code] > 1
    owner, code = owner[use], rank[code[use]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, columns):
        lo, hi = np.searchsorted(code, [first, first + columns])
        table = np.zeros((len(both), columns), np.float32)
        table[owner[lo:hi], code[lo:hi] - first] = 1
        out += table[: len(a)] @ table[len(a) :].T
    return out


def linked(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """A forest of the links within a block, or between two; ``frame`` has th, component, own (its block), i, j and s."""
    one, two = frame[frame["own"] == frame["i"]], frame[frame["own"] == frame["j"]]
    a, b = ([np.asarray(x, np.int64) for x in side["s"]] for side in (one, two))
    out = pd.DataFrame({"a": [], "b": []}, dtype="int64")
    if not a or not b:
        return out
    both = shared_shingles(a, b)
    total = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None]
    near = (both >= threshold * (total - both)) & (one["component"].to_numpy()[:, None] != two["component"].to_numpy()[None])
    nodes, inverse = np.unique(np.concatenate([one["th"], two["th"]]), return_inverse=True)
    i, j = np.nonzero(near)
    links = _forest(len(nodes), inverse[i], inverse[len(one) + j])
    return pd.DataFrame({"a": [nodes[u] for u, _ in links], "b": [nodes[v] for _, v in links]}, dtype="int64") if links else out


def all_with_all(members: DataFrame, sets: DataFrame, path: str, threshold: float = SIMILARITY) -> DataFrame:
    """Links ``(a, b)`` that connect the similar texts of each group; ``members`` has th, grp and component, links of one component aside.

    How many blocks each group has is written to ``path``, so that a large group's rows are split where they meet it.
    """
    rows = members.join(sets, "th").select("th", "grp", "component", "s", F.size("s").alias("size"))
    blocks = rows.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("m"))
    dealt = rows.join(materialise(blocks, path), "grp").withColumn("own", F.pmod(F.xxhash64("th", F.lit(5)), F.col("m")).cast("int"))
    sides = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    spread = dealt.select("grp", "th", "component", "own", "s", F.explode(sides).alias("x")).select("grp", "x.i", "x.j", "th", "component", "own", "s")
    return spread.groupBy("grp", "i", "j").applyInPandas(lambda frame: linked(frame, threshold), "a long, b long")


def components(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """``(doc_id, component_id)`` for every row: the smallest doc_id reachable over links of similar texts."""
    spark = docs.sparkSession
    bound_batches(spark)
    root = scratch_dir(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = rows.select("doc_id", F.xxhash64("text").alias("th"), "text")
    marks = materialise(_mapped(texts, keys_of, "bands"), f"{root}/marks")
    nodes = marks.groupBy("th").agg(F.min("doc_id").alias("low"), F.first("bands").alias("x"))
    nodes = materialise(nodes.select("th", "low", F.slice("x", 1, BANDS).alias("bands"), F.element_at("x", BANDS + 1).alias("fp")), f"{root}/nodes")
    near = materialise(close_prints(nodes.select("th", "fp"), root), f"{root}/near")
    release_shuffles(spark)
    keys = nodes.select("th", F.posexplode("bands").alias("no", "key"))
    # Counts are written before members are joined to them, so that a key of many texts is split.
    counts = materialise(keys.groupBy("no", "key").agg(F.count("*").alias("n")).where("n > 1"), f"{root}/counts")
    members = materialise(keys.join(counts, ["no", "key"]), f"{root}/members")
    weight = members.groupBy("th").agg(F.sum("n").alias("w"))
    led = materialise(members.join(weight, "th").groupBy("no", "key").agg(F.max(F.struct("w", "th"))["th"].alias("leader")), f"{root}/leaders")
    pairs = members.join(led, ["no", "key"]).where("th <> leader").select(F.least("th", "leader").alias("a"), F.greatest("th", "leader").alias("b"))
    pairs = materialise(near.unionByName(pairs).distinct(), f"{root}/pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("th")).distinct()
    sets = materialise(_mapped(texts.select("th", "text").join(ids, "th", "left_semi").dropDuplicates(["th"]), shingles, "s"), f"{root}/sets")
    edges = materialise(similar(pairs, sets, threshold), f"{root}/edges")
    release_shuffles(spark)
    groups = materialise(connected_components(edges, few=FEW_EDGES).select(F.col("node").alias("th"), "component"), f"{root}/groups")
    # Texts that share keys, directly or through others, and that the links so far leave apart.
    met = connected_components(pairs, few=FEW_EDGES).select(F.col("node").alias("th"), F.col("component").alias("grp"))
    placed = materialise(met.join(groups, "th", "left").select("th", "grp", F.coalesce("component", "th").alias("component")), f"{root}/placed")
    apart = placed.groupBy("grp").agg(F.count("*").alias("c"), F.min("component").alias("x"), F.max("component").alias("y")).where("c > 2 and x <> y").select("grp")
    apart = materialise(apart, f"{root}/apart")
    more = materialise(all_with_all(placed.join(apart, "grp"), sets, f"{root}/blocks", threshold), f"{root}/more")
    release_shuffles(spark)
    groups = materialise(connected_components(edges.unionByName(more), few=FEW_EDGES).select(F.col("node").alias("th"), "component"), f"{root}/final")
    known = nodes.select("th", "low").join(groups, "th", "left").select("th", "low", F.coalesce("component", "th").alias("component"))
    lows = known.groupBy("component").agg(F.min("low").alias("component_id"))
    table = materialise(known.join(lows, "component").select("th", "component_id"), f"{root}/table")
    for name in ("nodes", "prints", "near", "counts", "members", "leaders", "pairs", "sets", "edges", "groups", "placed", "apart", "blocks", "more", "final"):
        remove(spark, f"{root}/{name}")
    return marks.select("doc_id", "th").join(table, "th").select("doc_id", "component_id")


def keep_one(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The documents, one of each group of near copies: the one with the smallest doc_id.

    Rows that share the smallest doc_id of a group all stay.
    """
    keep = components(docs, threshold).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_keep")).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["_keep"]), "left_semi")
