"""Language identification by Bayesian fusion of a text's likelihood with what surrounds it.

Evidence: the text's byte-trigram likelihood under each language (and under a
background that any byte string has), tempered because trigrams overlap; the
language that the markup declares, by how often each declaration goes with
each language in this corpus; and a prior for the host, smoothed toward its
address suffix's, and that toward the corpus's, from the texts' own posteriors
added up by grouped aggregation. A row's own posterior is taken out of its
host's counts.

Languages are those that ``LEAST_SHARE`` or more of the rows with a declaration
declare, and ``LEAST_ROWS`` rows at least, counted over all rows. Only the trigram
model is fitted on a sample, of ``TRAIN_ROWS`` rows of each; priors and
declarations are counted over all rows.

Defined results: a null or empty text, or one without letters, gives no
evidence of its own: it gets the most likely language of its surroundings, and
is not kept; null declarations, suffixes and hosts are values like any other;
of equally likely languages the first by name counts; languages that too few
rows declare are told as ``und`` and not kept; rows that repeat are judged each;
further columns are not looked at; very long texts are read whole; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from attesta.llm.common import bound_batches
from attesta.llm.tokens import forget
from attesta.session import materialise, scratch_dir

#: Share of declared rows, and rows, that make a language; declared rows of each that the model is fitted on, at most.
LEAST_SHARE, LEAST_ROWS, TRAIN_ROWS = 0.01, 10, 1_000
#: Declarations that name no language.
NO_LANGUAGE = ("", "mul", "none", "null", "und", "unknown", "x-default", "xx", "zxx")
#: Hashed trigrams (log2), their smoothing, and the share of a text's log likelihood that counts.
TABLE_BITS, SMOOTHING, TEMPER = 16, 0.05, 1 / 3
#: Rows' worth of trust in a suffix over one host, and in the corpus over one suffix; least posterior of a kept row.
HOST_WEIGHT, SUFFIX_WEIGHT, LEAST = 20.0, 50.0, 0.6
OTHER = "und"


def _letters() -> np.ndarray:
    code = np.arange(256)
    table = np.where(code >= 128, code, 32)
    table[65:91] = table[97:123] = np.arange(97, 123)
    return table.astype(np.uint32)


_LETTER = _letters()


def trigrams(text: str | None, at: int = 1 << 20) -> Iterator[np.ndarray]:
    """Hashed trigrams of letters and the spaces around them, in runs of at most ``at`` bytes of text."""
    raw = (text or "").lower().encode("utf-8", "surrogatepass")
    for i in range(0, len(raw), at):
        b = np.concatenate([[np.uint32(32)], _LETTER[np.frombuffer(raw, np.uint8, min(at, len(raw) - i), i)], [np.uint32(32)]])
        b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])]  # runs of spaces count as one
        with np.errstate(over="ignore"):
            code = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1)
        yield code >> np.uint32(32 - TABLE_BITS)


def languages_of(rows: DataFrame) -> tuple[str, ...]:
    """Languages that enough rows declare, by name; a share of each bounds how many there can be."""
    counts = rows.where(F.col("declared").isNotNull() & ~F.col("declared").isin(*NO_LANGUAGE) & F.col("text").isNotNull()).groupBy("declared").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    return tuple(sorted(r["declared"] for r in counts.where(F.col("n") >= max(LEAST_ROWS, LEAST_SHARE * total)).collect()))


def fit(rows: DataFrame, languages: tuple[str, ...], train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Log likelihood of each trigram under each language and, last, the background."""
    known = rows.where(F.col("declared").isin(*languages) & F.col("text").isNotNull())
    if not languages:
        return np.full((1 << TABLE_BITS, 1), -TABLE_BITS * np.log(2), np.float32)
    parts = []
    for lang in languages:  # the smallest hashes: a bounded top-k of ids, then those rows' texts
        parts.append(known.where(F.col("declared") == lang).select("key", "declared").orderBy(F.xxhash64("key"), "key").limit(train_rows))
    ids = parts[0]
    for some in parts[1:]:
        ids = ids.unionByName(some)
    texts = known.join(F.broadcast(ids.select("key").distinct()), "key").select("declared", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), 1 << TABLE_BITS), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for code in trigrams(text):
                    total[languages.index(lang)] += np.bincount(code, minlength=1 << TABLE_BITS)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["lang", "code", "n"])

    sums = texts.mapInArrow(count, "lang int, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(languages), 1 << TABLE_BITS))
    counts[sums["lang"].to_numpy(int), sums["code"].to_numpy(int)] = sums["n"].to_numpy(float)
    smooth = counts + SMOOTHING
    table = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    return np.vstack([table, np.full((1, 1 << TABLE_BITS), -TABLE_BITS * np.log(2))]).T.astype(np.float32).copy()


def text_likelihood(rows: DataFrame, table: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` columns, the number of trigrams and the tempered log likelihoods of each row's text."""
    shared = rows.sparkSession.sparkContext.broadcast(table)
    kinds = dict(rows.select(*keep).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        ll = shared.value
        for batch in batches:
            n, sums = [], []
            for text in batch.column(len(keep)).to_pylist():
                total, size = np.zeros(ll.shape[1]), 0
                for code in trigrams(text):
                    total += ll[code].sum(axis=0, dtype=np.float64)
                    size += len(code)
                n.append(size)
                sums.append((TEMPER * total).tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(n, pa.int64()), pa.array(sums, pa.list_(pa.float64()))], [*keep, "n", "ll"])

    return rows.select(*keep, "text").mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", n long, ll array<double>")


def softmax(ll: str, size: int) -> Column:
    """Posterior of log weights in an array column, over ``size`` classes."""
    top = F.array_max(ll)
    e = F.transform(ll, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def identify(rows: DataFrame, keep: list[str], languages: tuple[str, ...] | None = None, table: np.ndarray | None = None) -> DataFrame:
    """``keep`` columns with language, posterior, kept, and the language that the text alone tells.

    ``rows`` has key, text, declared, suffix and host; ``languages`` and ``table``
    are those of the trigram model if it was fitted elsewhere.
    """
    spark, root = rows.sparkSession, scratch_dir(rows.sparkSession)
    bound_batches(spark)
    languages = languages_of(rows) if languages is None else languages
    names = [*languages, OTHER]
    size = len(names)
    table = fit(rows, languages) if table is None else table
    own = list(dict.fromkeys([*keep, "declared", "suffix", "host"]))
    seen = materialise(text_likelihood(rows, table, own).withColumn("p", F.when(F.col("n") > 0, softmax("ll", size))), f"{root}/texts")

    sums = [F.coalesce(F.sum(F.col("p")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(size)]
    vector = F.array(*(F.col(f"s{i}") for i in range(size)))
    by_host = materialise(seen.groupBy("suffix", "host").agg(*sums), f"{root}/hosts")
    up = [F.sum(f"s{i}").alias(f"s{i}") for i in range(size)]
    whole = by_host.agg(*up).first()
    total = np.array([whole[f"s{i}"] or 0.0 for i in range(size)]) + 1.0
    corpus = F.array(*(F.lit(float(x)) for x in total / total.sum()))
    # Declarations beyond the languages count as one; so there are at most size + 1 rows.
    said = F.when(F.col("declared").isin(*names), F.col("declared")).when(F.col("declared").isNotNull(), F.lit(OTHER))
    declared = {r["said"]: np.array([r[f"s{i}"] for i in range(size)]) for r in seen.groupBy(said.alias("said")).agg(*sums).collect()}
    all_said = sum(declared.values(), np.zeros(size))
    evidence = {k: np.log((v + 0.5) / (all_said + 0.5 * max(1, len(declared)))).tolist() for k, v in declared.items() if k is not None}
    told = spark.createDataFrame(list(evidence.items()) or [(OTHER, [0.0] * size)], "said string, e array<double>")

    smooth = lambda own_counts, weight, parent: F.zip_with(own_counts, parent, lambda a, b: (a + F.lit(weight) * b))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)
    norm = lambda xs: F.transform(xs, lambda x: x / add(xs))
    suffixes = by_host.groupBy("suffix").agg(*up).select("suffix", norm(smooth(vector, SUFFIX_WEIGHT, corpus)).alias("suffix_prior"))
    hosts = materialise(
        by_host.alias("h").join(suffixes.alias("s"), F.col("h.suffix").eqNullSafe(F.col("s.suffix")))
        .select("h.suffix", "h.host", vector.alias("counts"), "suffix_prior"), f"{root}/priors")
    joined = (
        seen.withColumn("said", said).alias("r")
        .join(hosts.alias("h"), F.col("r.suffix").eqNullSafe(F.col("h.suffix")) & F.col("r.host").eqNullSafe(F.col("h.host")))
        .join(F.broadcast(told), "said", "left")
    )
    zero = F.array(*(F.lit(0.0) for _ in range(size)))
    others = F.zip_with("counts", F.coalesce("p", zero), lambda a, b: F.greatest(a - b, F.lit(0.0)))
    prior = norm(smooth(others, HOST_WEIGHT, F.col("suffix_prior")))
    weight = F.zip_with(F.zip_with("ll", F.coalesce("e", zero), lambda a, b: a + b), prior, lambda a, b: a + F.ln(b))
    picked = joined.select(*(F.col(f"r.{k}").alias(k) for k in keep), "n", "ll", weight.alias("w")).withColumn("post", softmax("w", size))
    best = F.array_max("post")
    place = F.array_position("post", best)
    return picked.select(
        *keep, F.element_at(F.array(*(F.lit(x) for x in names)), place.cast("int")).alias("language"), best.alias("posterior"),
        ((F.col("n") > 0) & (place != size) & (best >= LEAST)).alias("kept"),
        F.when(F.col("n") > 0, F.element_at(F.array(*(F.lit(x) for x in names)), F.array_position("ll", F.array_max("ll")).cast("int"))).alias("by_text"))


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents as evidence: ``lang`` is the declaration and ``source`` the host, with a suffix if it has a dot."""
    source = F.col("source").cast("string")
    suffix = F.when(F.contains(source, F.lit(".")), F.substring_index(F.lower(source), ".", -1))
    return docs.select(
        F.col("doc_id").cast("long").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("th"),
        F.lower("lang").alias("declared"), suffix.alias("suffix"), source.alias("host"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages as evidence: the markup's language, and the host and top-level suffix of the address; the path's first step goes with them."""
    host = F.regexp_extract(F.lower("url"), r"^[a-z]+://([^/:?#]+)", 1)
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<!--.*?-->|<[^>]*>|&[#a-zA-Z0-9]+;", " ")
    return pages.select(
        F.col("page_id").cast("long").alias("key"), "page_id", bare.alias("text"),
        F.nullif(F.substring_index(F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-zA-Z]+)", 1)), "-", 1), F.lit("")).alias("declared"),
        F.nullif(F.substring_index(host, ".", -1), F.lit("")).alias("suffix"), F.nullif(host, F.lit("")).alias("host"),
        F.regexp_extract("url", r"^[a-zA-Z]+://[^/]+/([^/?#]*)", 1).alias("path"))


def identified_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, language, posterior, kept)`` for every document."""
    return identify(document_rows(docs), ["doc_id"])


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is told with enough certainty."""
    verdict = identify(document_rows(docs), ["doc_id", "th"]).where("kept").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    return docs.join(verdict, docs["doc_id"].eqNullSafe(verdict["_id"]) & (F.xxhash64(docs["text"]) == verdict["_th"]), "left_semi")
