"""Coverage: which stretches of a source no triple of the item covers (gaps and islands).

Triples are found row by row in Arrow batches, so texts aren't shuffled for it;
what is left are gaps between sorted places, so all work is in proportion to the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from attesta.functions import text as T
from attesta.operators import grams
from attesta.session import bound_batches


def uncovered_runs(pairs: DataFrame, keys: list[str], source: str = "source", item: str = "item", least: int = 1, before: int = 3, after: int = 3) -> DataFrame:
    """One row for each maximal uncovered run: keys, start, length, words, context.

    ``source`` and ``item`` are token arrays of a row, one row for each key. A source of fewer than
    three tokens is one run if any of its words is missing from the item.
    """
    rows = pairs.select(*keys, F.col(source).alias("s"), F.col(item).alias("i"))
    tiny = rows.where((F.size("s") > 0) & (F.size("s") < 3) & (F.size(F.array_except("s", "i")) > 0)).select(
        *keys, F.lit(0).alias("start"), F.size("s").alias("length"), F.array_join("s", " ").alias("words"), F.array_join("s", " ").alias("context"))
    long = rows.where(F.size("s") >= 3)
    return _runs(_hits(long, keys), keys, least, before, after).unionByName(tiny.where(F.col("length") >= least))


def _hits(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, s, hits``: the places in ``s`` where triples begin that ``i`` has too."""
    bound_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (one, own), (two, other) = grams.flat(batch.column("s")), grams.flat(batch.column("i"))
            _, a, _, b = grams.units(one, own, two, other)
            start, known = a >= 0, b >= 0
            place = np.arange(len(own)) - np.searchsorted(own, own)
            hit = np.nonzero(start)[0][grams.found(a[start], own[start], b[known], other[known])]
            ends = np.searchsorted(own[hit], np.arange(batch.num_rows + 1)).astype(np.int32)
            hits = pa.ListArray.from_arrays(pa.array(ends), pa.array(place[hit].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (*keys, "s")), hits], [*keys, "s", "hits"])

    kinds = StructType([rows.schema[k] for k in (*keys, "s")]).add("hits", ArrayType(IntegerType()))
    return rows.select(*keys, "s", "i").mapInArrow(run, kinds)


def _runs(known: DataFrame, keys: list[str], least: int, before: int, after: int) -> DataFrame:
    """Runs of tokens that no found triple covers; ``s`` tokens, ``hits`` where triples that were found begin, ascending."""
    rows = known.select(*keys, "s", F.coalesce("hits", F.array().cast("array<int>")).alias("h"))
    gap = F.transform(F.sequence(F.lit(0), F.size("h")), lambda k: F.struct(F.coalesce(F.get("h", k - 1) + 3, F.lit(0)).alias("a"), F.coalesce(F.get("h", k) - 1, F.size("s") - 1).alias("b")))
    runs = rows.select(*keys, "s", F.explode(F.filter(gap, lambda r: r["b"] >= r["a"])).alias("r")).select(
        *keys, "s", F.col("r.a").alias("start"), (F.col("r.b") - F.col("r.a") + 1).alias("length"))
    first, stop = F.col("start"), F.col("start") + F.col("length")
    low = F.greatest(F.lit(0), first - before)
    words = F.array_join(F.slice("s", first + 1, F.col("length")), " ")
    context = F.concat_ws(" ", F.slice("s", low + 1, first - low), F.concat(F.lit("["), words, F.lit("]")), F.slice("s", stop + 1, F.lit(after)))
    return runs.where(F.col("length") >= least).select(*keys, "start", "length", words.alias("words"), context.alias("context"))


def corpus_uncovered(sources: DataFrame, item_grams: DataFrame, keys: list[str], tokens: str = "tokens", least: int = 3, before: int = 2, after: int = 2) -> DataFrame:
    """Runs of each source that no gram of a whole corpus (column ``gram``) covers.

    Only the source's grams and the corpus' matching ones meet in a join, so
    the corpus side may be of any size.
    """
    own = sources.select(*keys, F.posexplode(T.grams(tokens)).alias("pos", "gram"))
    wanted = own.select("gram").distinct()
    known = item_grams.select("gram").join(wanted, "gram", "left_semi").distinct()
    hits = own.join(known, "gram").groupBy(*keys).agg(F.array_sort(F.collect_set("pos")).alias("hits"))
    rows = sources.join(hits, keys, "left").where(F.size(tokens) > 0)
    return _runs(rows.select(*keys, F.col(tokens).alias("s"), "hits"), keys, least, before, after)
