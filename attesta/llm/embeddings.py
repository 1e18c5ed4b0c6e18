"""Embedding near-duplicates by an inverted multi-index.

Two codebooks, one for each half of the unit vectors, are fitted on a bounded
sample; their product is a grid of cells. Every vector stands in the cell of
its nearest centroids and looks into the cells that the multi-sequence order
(ascending sum of the two halves' distances) visits first, as many as the
target recall takes: the true neighbours of some vectors of the sample are
found by a scan over all rows, and their cells tell how many visits reach them.
Where that is no less work than comparing all vectors of a label, or too few
neighbours are known to tell, all are compared: the grid is one cell then.
What a vector meets is verified by the cosine in double precision, so no link
is below the threshold.

Vectors that are equal in label and components are one representative with a
multiplicity. A cell's members and those who look into it are compared in
blocks of ``BLOCK``, salted by hash, as matrix products; a block gives each
vector its number of links and a spanning forest of edges, never pairs. A pair
that both ends would find is counted by the end that looks, once.

The grid's centroids grow with the vectors of a label up to ``MOST_CENTROIDS`` of
each half; :func:`index_report` tells the recall that the visits reached.

Defined results: vectors that are null, zero, or have null or non-finite
components, and those with a null label, have no links; vectors of different
lengths or labels are not compared; a repeated vec_id gives its row each time;
a null vec_id gives a row and is never a component's id unless all its vectors'
are; equal vectors link with each other; further columns are not looked at; an
empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attesta.llm.common import bound_batches
from attesta.operators.graph import connected_components
from attesta.session import materialise, scratch_dir

#: Vectors that codebooks are fitted on, at most; those of them whose neighbours are looked for at first; neighbours that tell the number of visits.
SAMPLE, PROBED, LEAST_PAIRS = 8_192, 1_024, 1_000
#: Members of a cell aimed at; centroids of a half at most; vectors compared as one block.
OCCUPANCY, MOST_CENTROIDS, BLOCK = 64, 2048, 1024
TARGET_RECALL = 0.999


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of Lloyd's algorithm from distinct starting points."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centres = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near = distances(x, centres).argmin(axis=1)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        filled = counts > 0
        centres[filled] = sums[filled] / counts[filled, None]
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None], 0)


def multi_sequence(d1: np.ndarray, d2: np.ndarray, visits: int) -> list[tuple[int, int]]:
    """Cells in ascending order of ``d1[i] + d2[j]``, the first ``visits`` of them."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    heap, seen, out = [(d1[o1[0]] + d2[o2[0]], 0, 0)], {(0, 0)}, []
    while heap and len(out) < visits:
        _, i, j = heapq.heappop(heap)
        out.append((int(o1[i]), int(o2[j])))
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(o1) and b < len(o2) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (d1[o1[a]] + d2[o2[b]], a, b))
    return out


class Index:
    """Codebooks of the two halves for vectors of one length."""

    def __init__(self, first: np.ndarray, second: np.ndarray, visits: int, recall: float = 1.0):
        self.first, self.second, self.visits, self.recall = first, second, visits, recall

    def cells(self, x: np.ndarray) -> np.ndarray:
        """For each row the cells it visits, its own first, as numbers."""
        half = x.shape[1] // 2
        d1, d2 = distances(x[:, :half], self.first), distances(x[:, half:], self.second)
        n = min(self.visits, len(self.first) * len(self.second))
        return np.array([[i * len(self.second) + j for i, j in multi_sequence(a, b, n)] for a, b in zip(d1, d2, strict=True)], np.int32).reshape(len(x), n)


def codebooks(sample: np.ndarray, per_label: float) -> Index:
    """Codebooks for cells of about ``OCCUPANCY`` members."""
    half = sample.shape[1] // 2
    k = int(np.clip(np.sqrt(per_label / OCCUPANCY), 2, MOST_CENTROIDS))
    return Index(kmeans(sample[:, :half], k), kmeans(sample[:, half:], k), 1)


def one_cell(dim: int) -> Index:
    """A grid of one cell, in which every vector of a label meets every other."""
    return Index(np.zeros((1, dim // 2)), np.zeros((1, dim - dim // 2)), 1)


def neighbour_ranks(reps: DataFrame, dim: int, index: Index, reps_of: np.ndarray, queries: np.ndarray, labels: np.ndarray, threshold: float) -> pd.DataFrame:
    """Over all vectors of a length, how many neighbours the queries have in the cells they visit n-th: ``rank, n, share``.

    ``share`` sums each query's neighbours as parts of one, so that large groups don't outvote small ones.
    """
    shared = reps.sparkSession.sparkContext.broadcast((index, reps_of, queries, labels))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, own, queries, labels = shared.value
        for batch in batches:
            frame = batch.to_pandas()
            if len(frame):
                unit, lab = _unit(frame["embedding"].tolist()), frame["lab"].to_numpy()
                near = (queries @ unit.T >= threshold) & (labels[:, None] == lab[None]) & (own[:, None] != frame["rep"].to_numpy()[None])
                q, at = np.nonzero(near)
                met, back = np.unique(at, return_inverse=True)
                home = index.cells(unit[met])[:, 0] if len(met) else np.zeros(0, np.int32)
                pairs, n = np.unique(np.stack([q, home[back]]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0].astype(np.int32)), pa.array(pairs[1].astype(np.int32)), pa.array(n.astype(np.int64))], ["q", "cell", "n"])

    def ranks(frame: pd.DataFrame) -> pd.DataFrame:
        index, _, queries, _ = shared.value
        x, half = queries[int(frame["q"].iloc[0])][None], queries.shape[1] // 2
        sums = (distances(x[:, :half], index.first)[0][:, None] + distances(x[:, half:], index.second)[0][None]).ravel()
        place = np.searchsorted(np.sort(sums), sums[frame["cell"].to_numpy()], side="right")
        return pd.DataFrame({"rank": place.astype(np.int32), "n": frame["n"], "share": frame["n"] / frame["n"].sum()})

    rows = reps.where(F.size("embedding") == dim).select("rep", F.xxhash64("label").alias("lab"), "embedding")
    cells = rows.mapInArrow(scan, "q int, cell int, n long").groupBy("q", "cell").agg(F.sum("n").alias("n"))
    return cells.groupBy("q").applyInPandas(ranks, "rank int, n long, share double").groupBy("rank").agg(F.sum("n").alias("n"), F.sum("share").alias("share")).orderBy("rank").toPandas()


def fit(reps: DataFrame, dim: int, per_label: float, threshold: float, target: float = TARGET_RECALL) -> Index:
    """Codebooks for vectors of one length, and the visits that reach the target over all rows."""
    sample = reps.where(F.size("embedding") == dim).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("rep", "embedding", F.xxhash64("label").alias("lab")).toPandas()
    unit, own, labels = _unit(sample["embedding"].tolist()), sample["rep"].to_numpy(), sample["lab"].to_numpy()
    index = codebooks(unit, per_label)
    for n in sorted({min(PROBED, len(unit)), len(unit)}):
        ranks = neighbour_ranks(reps, dim, index, own[:n], unit[:n], labels[:n], threshold)
        if ranks["n"].sum() >= LEAST_PAIRS:
            break
    else:
        return one_cell(dim)
    reached = np.minimum(ranks["n"].cumsum() / ranks["n"].sum(), ranks["share"].cumsum() / ranks["share"].sum()).to_numpy()
    enough = np.flatnonzero(reached >= target)
    place = enough[0] if len(enough) else len(reached) - 1
    index.visits, index.recall = int(ranks["rank"].iloc[place]) + 1, float(reached[place])  # one cell more than it took
    return one_cell(dim) if index.visits * OCCUPANCY >= per_label else index


def representatives(rows: DataFrame) -> DataFrame:
    """One row for each distinct usable vector of a label: rep, label, embedding, copies, id_low."""
    usable = rows.where(
        F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
        & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0))
    same = usable.withColumn("rep", F.xxhash64("label", "embedding"))
    return same.groupBy("label", "embedding", "rep").agg(F.count("*").alias("copies"), F.min("vec_id").alias("low"))


def _unit(values: list) -> np.ndarray:
    x = np.array(values, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges ``(node, root)`` of the components that pairs ``a, b`` make of ``n`` nodes."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = np.flatnonzero(label != np.arange(n))
    return list(zip(moved.tolist(), label[moved].tolist(), strict=True))


def fit_all(reps: DataFrame, threshold: float) -> dict[int, Index]:
    """One index for each length of vectors."""
    sizes = reps.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels")).orderBy("dim").collect()
    return {r["dim"]: fit(reps, r["dim"], r["n"] / max(1, r["labels"]), threshold) for r in sizes}


def index_report(rows: DataFrame, threshold: float = 0.93) -> list[dict]:
    """For each length of vectors its grid, the cells that are visited, and the recall measured over all rows (1 where all are compared)."""
    reps = materialise(representatives(_vectors(rows)), f"{scratch_dir(rows.sparkSession)}/reps")
    return [{"dim": dim, "cells": len(x.first) * len(x.second), "visits": x.visits, "recall": x.recall} for dim, x in fit_all(reps, threshold).items()]


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")


def near_duplicates(rows: DataFrame, threshold: float = 0.93) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of vec_id, embedding, label."""
    spark = rows.sparkSession
    bound_batches(spark, 1024)
    root = scratch_dir(spark)
    rows = _vectors(rows)
    reps = materialise(representatives(rows), f"{root}/reps")
    indexes = fit_all(reps, threshold)
    shared = spark.sparkContext.broadcast(indexes)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            dims = frame["embedding"].map(len)
            for dim, some in frame.groupby(dims):
                unit = _unit(some["embedding"].tolist())
                cells = shared.value[dim].cells(unit)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some["rep"].to_numpy()), pa.array(some["copies"].to_numpy()), pa.array(some["lab"].to_numpy()), pa.array(np.full(len(some), dim, np.int32)),
                     pa.array([x.tobytes() for x in unit], pa.binary()), pa.array(cells.tolist(), pa.list_(pa.int32()))],
                    ["rep", "copies", "lab", "dim", "unit", "cells"])

    schema = "rep long, copies long, lab long, dim int, unit binary, cells array<int>"
    placed = materialise(reps.select("rep", "copies", F.xxhash64("label").alias("lab"), "embedding").mapInArrow(visit, schema), f"{root}/placed")
    again = spark.read.schema(placed.schema).parquet(f"{root}/placed")  # a relation of its own for each side
    home = placed.withColumn("cell", F.col("cells")[0])
    probe = again.withColumn("cell", F.explode("cells"))
    key = ["lab", "dim", "cell"]
    # Blocks of a cell: members and visitors are dealt out by hash, and each block of one meets each of the other.
    members = home.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("m"))
    visitors = probe.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("v"))
    # Written, so that a small grid is broadcast, and rows of a hot cell are split where they meet a large one.
    grid = materialise(members.join(visitors, key), f"{root}/grid")
    h = home.join(grid, key).select(*key, F.pmod(F.xxhash64("rep"), F.col("m")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("v") - 1)).alias("j"), "rep", "copies", "unit", "cells")
    p = probe.join(grid, key).select(*key, F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i"), F.pmod(F.xxhash64("rep", F.lit(3)), F.col("v")).alias("j"), "rep", "copies", "unit", F.col("cells")[0].alias("own"))
    block = [*key, "i", "j"]
    h, p = (x.select(*key, F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), *x.columns[5:]) for x in (h, p))

    def compare(members: pd.DataFrame, visitors: pd.DataFrame) -> pd.DataFrame:
        out = {"a": [], "b": [], "n": []}
        if len(members) and len(visitors):
            x = np.frombuffer(b"".join(members["unit"]), np.float64).reshape(len(members), -1)
            y = np.frombuffer(b"".join(visitors["unit"]), np.float64).reshape(len(visitors), -1)
            mine, theirs = members["rep"].to_numpy(), visitors["rep"].to_numpy()
            near = (y @ x.T >= threshold) & (theirs[:, None] != mine[None])
            if near.any():
                looks = np.stack(members["cells"].to_list())
                owns, which = np.unique(visitors["own"].to_numpy(), return_inverse=True)
                back = np.stack([(looks == o).any(axis=1) for o in owns])[which]  # whether the member visits the visitor's cell
                count = near @ members["copies"].to_numpy()
                other = (near & ~back).T @ visitors["copies"].to_numpy()
                for nodes, n in ((theirs, count), (mine, other)):
                    at = np.flatnonzero(n)
                    out["a"] += nodes[at].tolist()
                    out["b"] += nodes[at].tolist()
                    out["n"] += n[at].tolist()
                i, j = np.nonzero(near)
                nodes, inverse = np.unique(np.concatenate([theirs, mine]), return_inverse=True)
                for u, v in _forest(len(nodes), inverse[i], inverse[len(theirs) + j]):
                    out["a"].append(int(nodes[u]))
                    out["b"].append(int(nodes[v]))
                    out["n"].append(0)
        return pd.DataFrame(out, columns=["a", "b", "n"]).astype("int64")

    found = materialise(h.groupBy(*block).cogroup(p.groupBy(*block)).applyInPandas(compare, "a long, b long, n long"), f"{root}/found")
    links = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    nodes = connected_components(found.where("a <> b").select("a", "b")).select(F.col("node").alias("rep"), "component")
    known = reps.select("rep", "low", "copies").join(nodes, "rep", "left").join(links, "rep", "left").select("rep", "low", "copies", F.coalesce("component", "rep").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    lows = known.groupBy("component").agg(F.min("low").alias("component_id"))
    table = materialise(known.join(lows, "component").select("rep", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id"), f"{root}/table")
    usable = F.when(F.col("label").isNotNull() & F.col("embedding").isNotNull(), F.xxhash64("label", "embedding"))
    out = rows.select("vec_id", usable.alias("rep")).join(table, "rep", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
