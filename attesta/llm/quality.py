"""Quality by hierarchical empirical Bayes: document evidence within sites and their sections.

A logistic regression on bucketed style features (fitted by FTRL on a bounded
sample of labelled rows outside the evaluation fold) gives each document a
probability of its own. By grouped aggregation over all documents, soft counts
of those make a posterior of each site and each section of it, level by level:
a section is shrunk toward its site and a site toward the corpus, with the
weight that a moment fit of the spread between them gives, so that sparse
sites say little. A document's own share is taken out of its section and site.
The document's log odds move by as much as its section's differ from the
corpus's.

Defined results: a null or empty text has the features of none; null sites and
sections are groups of their own; without labels of both classes the
probability is the bias of what there is; several labels of a document count
as their minimum; a score of exactly 0.5 is kept; rows that repeat are judged
each, and learnt from each if they are labelled; further columns are not looked
at; very long texts are measured whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from attesta.llm.common import bound_batches
from attesta.llm.toxicity import Ftrl, held_out, sigmoid
from attesta.session import materialise, scratch_dir

#: Labelled rows that the classifier is fitted on, at most; passes over them; buckets of a measure; its features.
TRAIN_ROWS, EPOCHS, BUCKETS = 16_000, 6, 12
MEASURES = 14
BITS = 8  # 2**8 places hold MEASURES * BUCKETS features
#: Bounds of the weight that a parent has, in documents; probability is kept this far from 0 and 1.
LEAST_WEIGHT, MOST_WEIGHT, EDGE = 2.0, 10_000.0, 1e-4


def measures(text: str | None) -> np.ndarray:
    """Style of a whole text as numbers from 0 to 1."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(raw))
    by = np.bincount(raw, minlength=256)
    upper, lower, digits = by[65:91].sum(), by[97:123].sum(), by[48:58].sum()
    marks = by[33:48].sum() + by[58:65].sum() + by[91:97].sum() + by[123:127].sum()
    words, lines = text.split(), text.split("\n")
    m = max(1, len(words))
    same = sum(map(str.__eq__, words, words[1:]))
    return np.array(
        [
            min(1, np.log1p(len(words)) / 12), min(1, len(raw) / m / 20), upper / max(1, upper + lower), digits / n, marks / n, by[128:].sum() / n,
            len(set(words)) / m, same / m, len(set(lines)) / len(lines), min(1, m / len(lines) / 100),
            by[33] / m, by[124] / m, (by[35] + by[36] + by[37] + by[38] + by[42]) / m / 3, (by[46] + by[44]) / m,
        ]
    ).clip(0, 1)


def features(text: str | None) -> np.ndarray:
    """One bucket of each measure; finer near nought, where most shares lie."""
    x = np.floor(np.sqrt(measures(text)) * (BUCKETS - 1e-9)).astype(np.int64)
    return x + np.arange(MEASURES) * BUCKETS


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias from a bounded sample of labelled rows, those with the smallest hashes."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([features(x).tolist() for x in batch.column(2).to_pylist()], pa.list_(pa.int64()))], ["doc_id", "y", "at"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            examples += zip(*(c.to_pylist() for c in batch.columns), strict=True)
        examples.sort(key=lambda e: (e[0] * 0x9E3779B97F4A7C15 & ((1 << 64) - 1), e[1], e[2]))
        model = Ftrl(BITS, alpha=0.1, l1=0.5)
        for _ in range(epochs):
            for _, y, at in examples:
                model.learn(np.asarray(at), y)
        at, w = model.weights()
        dense = np.zeros(1 << BITS)
        dense[at] = w
        yield pa.RecordBatch.from_arrays([pa.array([dense.tolist()], pa.list_(pa.float64())), pa.array([float(model.bias)])], ["w", "bias"])

    found = texts.mapInArrow(measure, "doc_id long, y int, at array<long>")
    row = found.repartition(1).mapInArrow(train, "w array<double>, bias double").first()
    return (np.zeros(1 << BITS), 0.0) if row is None else (np.array(row["w"]), row["bias"])


def evidence(rows: DataFrame, model: tuple[np.ndarray, float], keep: list[str]) -> DataFrame:
    """``keep`` columns and ``e``, the probability that the text alone gives."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kinds = dict(rows.select(*keep).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = shared.value
        for batch in batches:
            e = [sigmoid(float(w[features(x)].sum()) + bias) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(e, pa.float64())], [*keep, "e"])

    return rows.select(*keep, "text").mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", e double")


def pull(groups: DataFrame, parents: int) -> float:
    """Documents' worth of trust in the parent: a moment fit of a beta-binomial.

    ``groups`` has counts ``n``, sums ``k`` and the parent's mean ``m``, about which
    the spread is measured; each of ``parents`` takes a degree of freedom.
    """
    noise = F.col("m") * (1 - F.col("m"))
    r = groups.agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("k") / F.col("n") - F.col("m")) ** 2).alias("between"), F.sum(noise).alias("noise"), F.sum(F.col("n") * noise).alias("own"), F.count("*").alias("groups")).first()
    if not r["n"] or r["groups"] <= parents:
        return MOST_WEIGHT
    spread = max(1e-9, (r["between"] - r["noise"] * (1 - parents / r["groups"])) / r["n"])
    return float(np.clip(r["own"] / r["n"] / spread - 1, LEAST_WEIGHT, MOST_WEIGHT))


def _odds(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - EDGE)), F.lit(EDGE))
    return F.ln(p / (1 - p))


def grade(rows: DataFrame, model: tuple[np.ndarray, float], keep: list[str]) -> DataFrame:
    """``keep`` columns with evidence, section_mean, score and kept; ``rows`` has text, site and section."""
    root = scratch_dir(rows.sparkSession)
    bound_batches(rows.sparkSession)
    seen = materialise(evidence(rows, model, list(dict.fromkeys([*keep, "site", "section"]))), f"{root}/seen")
    sections = materialise(seen.groupBy("site", "section").agg(F.count("*").alias("n"), F.sum("e").alias("k")), f"{root}/sections")
    sites = sections.groupBy("site").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = sites.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("sites")).first()
    mean = float(np.clip(total["k"] / total["n"], EDGE, 1 - EDGE)) if total["n"] else 0.5
    table = materialise(
        sections.alias("c").join(sites.alias("s"), F.col("c.site").eqNullSafe(F.col("s.site")))
        .select("c.site", "c.section", "c.n", "c.k", F.col("s.n").alias("sn"), F.col("s.k").alias("sk")), f"{root}/table")
    # Sites differ from the corpus, sections from their own site.
    site_pull = pull(sites.withColumn("m", F.lit(mean)), 1)
    section_pull = pull(table.withColumn("m", F.col("sk") / F.col("sn")), total["sites"])
    joined = seen.alias("r").join(table.alias("t"), F.col("r.site").eqNullSafe(F.col("t.site")) & F.col("r.section").eqNullSafe(F.col("t.section")))
    site_mean = (F.col("sk") - F.col("e") + site_pull * mean) / (F.col("sn") - 1 + site_pull)
    section_mean = (F.col("k") - F.col("e") + section_pull * site_mean) / (F.col("n") - 1 + section_pull)
    score = 1 / (1 + F.exp(-(_odds(F.col("e")) + _odds(section_mean) - _odds(F.lit(mean)))))
    return joined.select(*(F.col(f"r.{k}").alias(k) for k in keep), F.col("e").alias("evidence"), section_mean.alias("section_mean"), score.alias("score"), (score >= 0.5).alias("kept"))


def graded_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, evidence, section_mean, score, kept)``; a document's site is its source, its section the language there."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").alias("site"), F.col("lang").alias("section"))
    return grade(rows, fit(docs, labels), ["doc_id"])


def graded_pages(pages: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The same for pages: site is the host, section the first step of the path."""
    from attesta.llm.language import page_rows

    rows = page_rows(pages).withColumnRenamed("host", "site").withColumnRenamed("path", "section")
    return grade(rows, fit(docs, labels), ["page_id"])
