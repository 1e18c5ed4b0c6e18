"""Graph operators: connected components and critical path."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attesta.session import materialise, remove, scratch_dir

#: Edges beyond which the least neighbours are written before edges are joined to them, so that a node of many edges is split.
MANY_EDGES = 1_000_000


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60, few: int = 0) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component = smallest node reachable.

    Alternates the large-star and small-star contractions until the edges are
    stars. Each round joins every edge once with one row per node, so a node
    with many neighbours only skews the edge side of a join; from
    ``MANY_EDGES`` on both sides are plain scans, so that Spark splits it.
    Rounds are written to the shared scratch folder. Null ends and self loops
    are ignored (a self loop contributes no node). Up to ``few`` edges (of
    longs) are contracted in one task instead, which spares the driver the rounds.
    """
    spark = edges.sparkSession
    root = scratch_dir(spark)
    current = materialise(
        edges.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
        .select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
        .distinct(),
        f"{root}/0",
    )
    signature = _signature(current)
    if 0 < signature[0] <= few:
        return current.coalesce(1).mapInArrow(_contract, "node long, component long")
    for step in range(1, max_rounds + 1):
        many = signature[0] > MANY_EDGES
        keep = (lambda df, name, step=step: materialise(df, f"{root}/{step}-{name}")) if many else (lambda df, name: df)
        current = materialise(_small_star(keep(_large_star(current, keep), "wide"), keep), f"{root}/{step}")
        for name in (f"{step - 1}", *((f"{step}-{x}" for x in ("wide", "large", "small")) if many else ())):
            remove(spark, f"{root}/{name}")
        last, signature = signature, _signature(current)
        if last == signature:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of all edges ``(a, b)`` with the smallest node reachable."""
    ends = [np.concatenate([b.column(k).to_numpy() for k in range(2)]).reshape(2, -1) for b in batches]
    if not ends:
        return
    nodes, at = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
    i, j = at.reshape(2, -1)
    low = np.arange(len(nodes))
    while True:
        least, new = np.minimum(low[i], low[j]), low.copy()
        for x in (low[i], low[j]):
            np.minimum.at(new, x, least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[low])], ["node", "component"])


def _large_star(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    low = (
        edges.select(F.col("b").alias("u"), F.col("b").alias("m"))
        .unionByName(edges.select(F.col("a").alias("u"), F.col("b").alias("m")))
        .groupBy("u").agg(F.min("m").alias("m"))
    )
    low = keep(low, "large")
    return edges.join(low, edges["b"] == low["u"]).select("a", F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    low = keep(edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "small")
    moved = edges.join(low, edges["a"] == low["u"]).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def critical_path(activities: DataFrame, edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``(graph, id, d, es, ef, ls, lf, critical)`` of activity networks.

    ``activities``: graph, id, d. ``edges``: graph, pred, id. Both passes
    settle all activities of one depth in a round, so rounds grow with the
    longest chain only. A round reads what the last one settled and what still
    waits for some of its needs; settled rows are written once, each round in
    a folder of its own below the shared scratch folder. An unknown
    predecessor or a cycle raises.
    """
    spark, root = activities.sparkSession, scratch_dir(activities.sparkSession)
    acts = materialise(activities.select("graph", "id", F.col("d").cast("double").alias("d")), f"{root}/acts")
    links = materialise(edges.select("graph", "pred", "id").distinct(), f"{root}/links")
    ends = links.select("graph", F.col("pred").alias("id")).unionByName(links.select("graph", "id"))
    if ends.join(acts, ["graph", "id"], "left_anti").limit(1).count():
        raise ValueError("an edge names an unknown activity")
    total = acts.count()

    def settle(into: str, out_of: str, name: str) -> DataFrame:
        """Longest sum of durations over all that must come first, layer by layer."""
        turned = links.select("graph", F.col(into).alias("id"), F.col(out_of).alias("needs"))
        needs = materialise(acts.join(turned.groupBy("graph", "id").agg(F.count("*").alias("w")), ["graph", "id"], "left").select("graph", "id", "d", F.coalesce("w", F.lit(0)).alias("w")), f"{root}/{name}-needs")
        first = needs.where("w = 0").select("graph", "id", F.lit(0.0).alias("at"), F.col("d").alias("after"))
        layer = materialise(first, f"{root}/{name}/0")
        waiting = materialise(needs.select("graph", "id", F.lit(0).cast("long").alias("have"), F.lit(0.0).alias("at")).where("false"), f"{root}/{name}-open0")
        settled, step = layer.count(), 0
        while settled < total:
            step += 1
            if step > max_rounds:
                raise RuntimeError("too many rounds")
            news = turned.join(layer.select("graph", F.col("id").alias("needs"), "after"), ["graph", "needs"]).select("graph", "id", F.lit(1).cast("long").alias("have"), F.col("after").alias("at"))
            held = waiting.unionByName(news).groupBy("graph", "id").agg(F.sum("have").alias("have"), F.max("at").alias("at"))
            held = materialise(held.join(needs, ["graph", "id"]), f"{root}/{name}-held{step}")
            layer = materialise(held.where("have = w").select("graph", "id", "at", (F.col("at") + F.col("d")).alias("after")), f"{root}/{name}/{step}")
            waiting = held.where("have < w").select("graph", "id", "have", "at")
            if step > 1:
                remove(spark, f"{root}/{name}-held{step - 1}")
            if not (n := layer.count()):
                raise ValueError("the network has a cycle")
            settled += n
        return spark.read.schema(layer.schema).parquet(*(f"{root}/{name}/{k}" for k in range(step + 1)))

    early = settle("id", "pred", "e").select("graph", "id", F.col("at").alias("es"), F.col("after").alias("ef"))
    late = settle("pred", "id", "l").select("graph", "id", F.col("at").alias("tail"))
    ends_at = early.groupBy("graph").agg(F.max("ef").alias("total"))
    table = acts.join(early, ["graph", "id"]).join(late, ["graph", "id"]).join(ends_at, "graph")
    lf = F.col("total") - F.col("tail")
    return table.select("graph", "id", "d", "es", "ef", (lf - F.col("d")).alias("ls"), lf.alias("lf"), (F.abs(lf - F.col("d") - F.col("es")) < 1e-9).alias("critical"))
