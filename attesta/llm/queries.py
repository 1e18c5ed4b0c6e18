"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from attesta.session import table


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level ids of every document, bit-packed, written and read back."""
    from attesta.llm.token_files import token_output

    out = token_output(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose fingerprints are linked at two bits or fewer."""
    from attesta.llm.simhash import simhash_components

    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a linear model of words, pairs and skip-grams."""
    from attesta.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document packed into windows of 4096 ids."""
    from attesta.llm.packing import pack

    pieces, _ = pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words that repeated windows of 35 words cover."""
    from attesta.llm.substrings import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one, or are within one word of it."""
    from attesta.llm.lines import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents leak, as they are or with other numbers, names and units."""
    from attesta.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors linked at a cosine of 0.93 or more within their label."""
    from attesta.llm.embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document from its text, declaration and source."""
    from attesta.llm.language import identified_documents

    return identified_documents(table(spark, sf_dir, "documents"))


def pages_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page from its text, markup, address suffix and host."""
    from attesta.llm.language import document_rows, fit, identify, languages_of, page_rows

    rows = document_rows(table(spark, sf_dir, "documents"))
    languages = languages_of(rows)
    return identify(page_rows(table(spark, sf_dir, "pages")), ["page_id"], languages, fit(rows, languages))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document within its source and the language there."""
    from attesta.llm.quality import graded_documents

    return graded_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pages_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every page within its host and path."""
    from attesta.llm.quality import graded_pages

    return graded_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_simhash": op2_simhash,
    "op3_toxicity": op3_toxicity,
    "op4_packing": op4_packing,
    "op5_lines": op5_lines,
    "op6_embeddings": op6_embeddings,
    "op7_language": op7_language,
    "pages_language": pages_language,
    "op8_quality": op8_quality,
    "pages_quality": pages_quality,
    "op9_substrings": op9_substrings,
    "op10_decontamination": op10_decontamination,
}
#: The other queries use a tokenizer, a hash or a fitted model that SQL has not.
ORACLE_SQL: dict[str, str] = {
    "op5_lines": """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
n AS (SELECT doc_id, no, x, lower(trim(x, ' ')) AS n FROM l),
f AS (SELECT doc_id, no, n FROM n WHERE n <> '' QUALIFY row_number() OVER (PARTITION BY n ORDER BY doc_id, no) = 1),
w AS (SELECT doc_id, no, n, string_split(n, ' ') AS w FROM f WHERE len(string_split(n, ' ')) >= 5),
v AS (SELECT doc_id, no, i, len(w) AS len, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS k FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w)),
near AS (SELECT a.doc_id, a.no FROM v a JOIN v b ON a.len = b.len AND a.i = b.i AND a.k = b.k WHERE (b.doc_id, b.no) < (a.doc_id, a.no)
  UNION SELECT v.doc_id, v.no FROM v JOIN w ON v.k = w.n AND v.len = len(w.w) + 1 WHERE (w.doc_id, w.no) < (v.doc_id, v.no)
  UNION SELECT w.doc_id, w.no FROM v JOIN w ON v.k = w.n AND v.len = len(w.w) + 1 WHERE (v.doc_id, v.no) < (w.doc_id, w.no)),
s AS (SELECT doc_id, no FROM f ANTI JOIN near USING (doc_id, no)),
k AS (SELECT n.doc_id, n.no, n.x, s.no IS NOT NULL AS own FROM n LEFT JOIN s USING (doc_id, no) WHERE n.n = '' OR s.no IS NOT NULL),
t AS (SELECT doc_id, count(*) AS c, string_agg(x, chr(10) ORDER BY no) AS t FROM k GROUP BY doc_id HAVING bool_or(own)),
z AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id)
SELECT doc_id, n_lines::INTEGER AS n_lines, (n_lines - coalesce(c, 0))::INTEGER AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM z LEFT JOIN t USING (doc_id)""",
    "op6_embeddings": """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS reach FROM embeddings UNION SELECT r.node, p.b FROM r JOIN p ON r.reach = p.a),
c AS (SELECT node AS vec_id, min(reach) AS component_id FROM r GROUP BY node), n AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op9_substrings": """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT k FROM i GROUP BY k HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM i SEMI JOIN r USING (k)),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM x ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
}
