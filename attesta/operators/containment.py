"""Containment: how much of one text's word triples another text has.

The index side (items, benchmark) is usually small; whether it is broadcast is
left to Spark's measured size. Occurrences in the probing text count each,
the source side is a set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructType

from attesta.functions import text as T
from attesta.functions.patterns import PRECISION_ERROR
from attesta.operators import grams
from attesta.session import bound_batches, materialise, scratch_dir


def gram_rows(df: DataFrame, keys: list[str], text: str, n: int = 3, exact: bool = True) -> DataFrame:
    """``keys, pos, gram``: one row for each run of ``n`` tokens."""
    return df.select(*keys, F.posexplode(T.grams(T.tokens(text, exact), n)).alias("pos", "gram"))


def containment(items: DataFrame, sources: DataFrame, item_key: str, source_key: str, text: str = "text", threshold: float = PRECISION_ERROR, exact: bool = True) -> DataFrame:
    """Pairs of item and source with hits / total of at least ``threshold``.

    Sources' grams are first cut down to those that any item has, and written.
    A source that has ``threshold`` of an item's grams has one of its rarest,
    those that make more than the rest of its total; only pairs that share one are counted, so
    grams that everything shares make no pairs.
    """
    spark, root = items.sparkSession, scratch_dir(items.sparkSession)
    wanted = gram_rows(items, [item_key], text, exact=exact)
    counted = materialise(wanted.groupBy(item_key, "gram").agg(F.count("*").alias("times")), f"{root}/counted")
    totals = counted.groupBy(item_key).agg(F.sum("times").alias("total"))
    have = sources.select(source_key, F.explode(F.array_distinct(T.grams(T.tokens(text, exact)))).alias("gram")).join(counted.select("gram").distinct(), "gram", "left_semi")
    if threshold > 0:
        have = materialise(have, f"{root}/have")
        seen = have.groupBy("gram").agg(F.count("*").alias("df"))
        rarest = Window.partitionBy(item_key).orderBy("df", "gram").rowsBetween(Window.unboundedPreceding, -1)
        ranked = counted.join(seen, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0))).join(totals, item_key).withColumn("before", F.coalesce(F.sum("times").over(rarest), F.lit(0)))
        probes = ranked.where((F.col("before") <= (1 - threshold) * F.col("total") + 1e-9) & (F.col("df") > 0)).select(item_key, "gram")
        pairs = have.join(probes, "gram").select(item_key, source_key).distinct()
        hits = pairs.join(counted, item_key).join(spark.read.schema(have.schema).parquet(f"{root}/have"), [source_key, "gram"], "left_semi").groupBy(item_key, source_key).agg(F.sum("times").alias("hits"))
    else:
        hits = have.join(counted, "gram").groupBy(item_key, source_key).agg(F.sum("times").alias("hits"))
    return hits.join(totals, item_key).where(F.col("hits") >= threshold * F.col("total")).select(
        item_key, source_key, "hits", "total", (F.col("hits") / F.col("total")).alias("precision"))


def segment_precision(segments: DataFrame, sources: DataFrame, owner: list[str], scope: str, text: str = "text", exact: bool = True) -> DataFrame:
    """Pooled precision of each owner's segments against the source of its scope.

    ``segments`` has the owner's keys (``scope`` among them) and one row for
    each segment; triples never cross segments, and a segment of one or two
    tokens is scored by its tokens. ``sources`` has the scope and its tokens in
    ``tokens``, concatenated across lines. An owner without tokens scores one.
    """
    rest = [k for k in owner if k != scope]
    spark = segments.sparkSession
    bound_batches(spark)
    # Tokens have no spaces, and travel as one string.
    toks = segments.select(scope, F.struct(*rest, F.array_join(T.tokens(text, exact), " ").alias("_t")).alias("_x")).groupBy(scope).agg(F.collect_list("_x").alias("_x"))
    rows = toks.join(sources.select(scope, F.col("tokens").alias("_s")), scope, "left").select(scope, "_x", "_s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, row = grams.flat(batch.column("_x"))
            own = own.field("_t").to_pylist(), {k: own.field(k) for k in rest}
            split = [x.split(" ") if x else [] for x in own[0]]
            (one, seg), (two, src) = grams.flat(pa.array(split, pa.list_(pa.string()))), grams.flat(batch.column("_s"))
            token, gram, known, triples = grams.units(one, seg, two, src)
            short = np.array([len(x) < 3 for x in split], bool)[seg] if len(seg) else np.zeros(0, bool)
            hit, some, there = np.zeros(len(one), bool), gram >= 0, triples >= 0
            hit[some] = grams.found(gram[some], row[seg[some]], triples[there], src[there])
            hit[short] = grams.found(token[short], row[seg[short]], known, src)
            hits, total = (np.bincount(seg[x], minlength=len(split)) for x in (hit, some | short))
            columns = [batch.column(scope).take(pa.array(row)) if k == scope else own[1][k] for k in owner]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(hits, pa.int64()), pa.array(total, pa.int64())], [*owner, "hits", "total"])

    kinds = StructType([segments.schema[k] for k in owner]).add("hits", LongType()).add("total", LongType())
    scores = rows.mapInArrow(run, kinds).groupBy(*owner).agg(F.sum("hits").alias("hits"), F.sum("total").alias("total"))
    return scores.select(*owner, "hits", "total", F.coalesce(F.try_divide("hits", "total"), F.lit(1.0)).alias("precision"))


def unknown_words(cells: DataFrame, vocabulary: DataFrame, keys: list[str], text: str = "text", exact: bool = True) -> DataFrame:
    """Tokens of each cell that the vocabulary (column ``word``) lacks, repeats included."""
    return cells.select(*keys, F.posexplode(T.tokens(text, exact)).alias("pos", "word")).join(vocabulary.select("word").distinct(), "word", "left_anti")
