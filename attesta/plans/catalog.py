"""Registered queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from attesta.functions import patterns as P, text as T
from attesta.operators import containment as C, coverage as V, graph, items, layout, multiset, repeated, validate
from attesta.plans.registry import gram_sql, query, tok_sql
from attesta.session import table
from attesta.sources import markup, sinks

_CONTAIN = f"""
items AS (SELECT item_id, {tok_sql('text')} AS t FROM benchmark),
ig AS (SELECT item_id, gram, count(*) AS times FROM (SELECT item_id, unnest({gram_sql('t')}) AS gram FROM items) GROUP BY ALL),
tot AS (SELECT item_id, sum(times) AS total FROM ig GROUP BY item_id),
dt AS (SELECT doc_id, {tok_sql('text')} AS t FROM documents),
dg AS (SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, unnest({gram_sql('t')}) AS gram FROM dt)),
pairs AS (SELECT item_id, doc_id, sum(times) AS hits FROM ig JOIN dg USING (gram) GROUP BY ALL)
"""


@query(f"WITH {_CONTAIN} SELECT item_id, doc_id, hits::BIGINT AS hits, total::BIGINT AS total, hits / total AS precision FROM pairs JOIN tot USING (item_id) WHERE hits >= 0.9 * total")
def benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold nine tenths or more of a benchmark item's word triples."""
    return C.containment(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id", exact=False)


@query(f"""WITH seg AS (SELECT conv_id, turn, {tok_sql('s')} AS t FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS s FROM conversations WHERE role = 'assistant')),
units AS (SELECT conv_id, turn, 1 AS n, unnest(t) AS unit FROM seg WHERE len(t) < 3 UNION ALL SELECT conv_id, turn, 3, unnest({gram_sql('t')}) FROM seg WHERE len(t) >= 3),
src AS (SELECT conv_id, flatten(list({tok_sql('text')} ORDER BY turn)) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id),
known AS (SELECT DISTINCT conv_id, 1 AS n, unnest(t) AS unit FROM src UNION SELECT DISTINCT conv_id, 3, unnest({gram_sql('t')}) FROM src),
sc AS (SELECT u.conv_id, u.turn, count(k.unit) AS hits, count(*) AS total FROM units u LEFT JOIN known k ON u.conv_id = k.conv_id AND u.n = k.n AND u.unit = k.unit GROUP BY ALL)
SELECT a.conv_id, a.turn, coalesce(hits, 0)::BIGINT AS hits, coalesce(total, 0)::BIGINT AS total, coalesce(hits / total, 1.0) AS precision
FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'assistant') a LEFT JOIN sc USING (conv_id, turn)""")
def segment_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each answer's lines stands in what the user said in that conversation."""
    turns = table(spark, sf_dir, "conversations")
    segments = turns.where("role = 'assistant'").select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("text"))
    said = turns.where("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", T.tokens("text", False).alias("t")))).alias("x"))
    return C.segment_precision(segments, said.select("conv_id", F.flatten(F.col("x.t")).alias("tokens")), ["conv_id", "turn"], "conv_id", exact=False)


_RUNS = """
pos AS (SELECT *, generate_subscripts(s, 1) AS p FROM base),
cov AS (SELECT *, (coalesce(f[p], false) OR (p > 1 AND coalesce(f[p - 1], false)) OR (p > 2 AND coalesce(f[p - 2], false))) AS c FROM pos),
isl AS (SELECT *, p - row_number() OVER (PARTITION BY {keys} ORDER BY p) AS g FROM cov WHERE NOT c),
run AS (SELECT {keys}, any_value(s) AS s, min(p) AS a, count(*) AS length FROM isl GROUP BY {keys}, g)
SELECT {keys}, (a - 1)::INTEGER AS start, length::INTEGER AS length, array_to_string(s[a:a + length - 1], ' ') AS words,
concat_ws(' ', nullif(array_to_string(s[greatest(1, a - {before}):a - 1], ' '), ''), '[' || array_to_string(s[a:a + length - 1], ' ') || ']', nullif(array_to_string(s[a + length:a + length + {after} - 1], ' '), '')) AS context
FROM run WHERE length >= {least}"""


@query(f"""WITH {_CONTAIN}, part_of AS (SELECT item_id, doc_id FROM pairs JOIN tot USING (item_id) WHERE hits >= 0.05 * total),
base AS (SELECT item_id, doc_id, i.t AS s, list_transform({gram_sql('i.t')}, lambda g: list_contains({gram_sql('d.t')}, g)) AS f FROM part_of JOIN items i USING (item_id) JOIN dt d USING (doc_id) WHERE len(i.t) >= 3),
{_RUNS.format(keys='item_id, doc_id', before=3, after=3, least=1)}""")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of benchmark items that a document which holds some of them lacks."""
    bench, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    pairs = C.containment(bench, docs, "item_id", "doc_id", threshold=0.05, exact=False).select("item_id", "doc_id")
    sides = pairs.join(bench.select("item_id", T.tokens("text", False).alias("source")), "item_id").join(docs.select("doc_id", T.tokens("text", False).alias("item")), "doc_id")
    return V.uncovered_runs(sides, ["item_id", "doc_id"])


@query(f"""WITH {_CONTAIN}, allg AS (SELECT DISTINCT gram FROM dg), hit AS (SELECT item_id, list(gram) AS have FROM (SELECT DISTINCT item_id, gram FROM ig SEMI JOIN allg USING (gram)) GROUP BY item_id),
base AS (SELECT i.item_id, t AS s, list_transform({gram_sql('t')}, lambda g: coalesce(list_contains(have, g), false)) AS f FROM items i LEFT JOIN hit USING (item_id) WHERE len(t) > 0),
{_RUNS.format(keys='item_id', before=2, after=2, least=3)}""")
def corpus_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three words or more of benchmark items that no document holds."""
    sources = table(spark, sf_dir, "benchmark").select("item_id", T.tokens("text", False).alias("tokens"))
    grams = table(spark, sf_dir, "documents").select(F.explode(T.grams(T.tokens("text", False))).alias("gram"))
    return V.corpus_uncovered(sources, grams, ["item_id"])


@query(f"""WITH n AS (SELECT source, lang, unnest(list_filter({tok_sql('text')}, lambda t: regexp_matches(t, '^\\d'))) AS value FROM documents),
c AS (SELECT source, value, count(*) FILTER (lang = 'en') AS l, count(*) FILTER (lang <> 'en') AS r FROM n GROUP BY ALL)
SELECT source, value, greatest(l - r, 0)::BIGINT AS missing, greatest(r - l, 0)::BIGINT AS extra FROM c WHERE l <> r""")
def number_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that a source's English documents have more often than its others, and the other way."""
    rows = table(spark, sf_dir, "documents").select("source", "lang", F.explode(T.numbers(T.tokens("text", False))).alias("value"))
    return multiset.multiset_difference(rows.where("lang = 'en'"), rows.where("lang <> 'en'"), ["source"], "value")


@query("""WITH l AS (SELECT source, doc_id, regexp_replace(lower(trim(x, ' ')), '\\d+', '#', 'g') AS form FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)),
c AS (SELECT source, form, count(DISTINCT doc_id) AS c FROM l WHERE form <> '' GROUP BY ALL), n AS (SELECT source, count(DISTINCT doc_id) AS n FROM l GROUP BY ALL)
SELECT source, form, c, n FROM c JOIN n USING (source) WHERE n >= 2 AND c >= greatest(2, floor((n + 1) * 0.1::DOUBLE))""")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line forms that a tenth of a source's documents share."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("source", "doc_id", F.explode(F.split("text", "\n")).alias("text"))
    return repeated.repeated_forms(lines, "source", "doc_id", share=0.1)


@query("""WITH l AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '\\s+$', '') AS x, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
k AS (SELECT doc_id, CASE WHEN no = 1 AND starts_with(x, '#!') THEN 'meta' WHEN regexp_matches(x, '^=== page (\\d+) ===\\s*$') THEN 'page' WHEN starts_with(x, '#~') THEN 'ignored' WHEN x = '' THEN 'blank' ELSE 'text' END AS kind FROM l)
SELECT doc_id, kind, count(*) AS n FROM k GROUP BY ALL""")
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of source lines in each document."""
    return markup.source_lines(table(spark, sf_dir, "documents")).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '\\s+$', '') AS x, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents)
SELECT doc_id, no::INTEGER AS no, 1 AS page, row_number() OVER (PARTITION BY doc_id ORDER BY no)::INTEGER AS k FROM l WHERE x <> ''""")
def line_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinal of each text line on its page."""
    return markup.line_ordinals(markup.source_lines(table(spark, sf_dir, "documents"))).select("doc_id", "no", "page", "k")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
b AS (SELECT doc_id, no, length(x)::DOUBLE AS x1 FROM l), e AS (SELECT doc_id, list_sort(list(x1)) AS s FROM b GROUP BY doc_id),
r AS (SELECT doc_id, CASE WHEN len(s) < 10 THEN s[len(s)] ELSE s[floor((len(s) - 1) * 0.9::DOUBLE)::INTEGER + 1] END AS edge FROM e)
SELECT doc_id, no::INTEGER AS no, x1 FROM b JOIN r USING (doc_id) WHERE x1 < edge - greatest(1.0::DOUBLE, edge) * 0.12::DOUBLE""")
def short_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that end well before their document's right edge; a character is one unit wide."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x"))
    boxes = lines.select("doc_id", (F.col("i") + 1).alias("no"), F.lit(0.0).alias("x0"), F.length("x").cast("double").alias("x1"))
    return layout.short_lines(boxes, ["doc_id"]).select("doc_id", "no", "x1")


@query("SELECT page_id, regexp_replace(html, '</?[A-Za-z!][^>]*>', ' ', 'g') AS text FROM pages")
def html_bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without tags."""
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags("html").alias("text"))


@query(f"""WITH l AS (SELECT doc_id, source, string_split(text, chr(10)) AS x FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(source, '{P.SOLUTION_WORDS}') THEN 'solution' WHEN regexp_matches(source, '{P.READING_WORDS}') THEN 'reading'
WHEN regexp_matches(lower(array_to_string(x[1:40], ' ')), '{P.SOLUTION_HEAD}') THEN 'solution'
WHEN len(list_filter(x, lambda s: regexp_matches(s, '{P.QUESTION_LINE}'))) >= 2 THEN 'paper' ELSE 'reading' END AS role FROM l""")
def doc_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role of each document by the name of its source and its first lines."""
    docs = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    asked = F.size(F.filter(lines, lambda s: s.rlike(P.QUESTION_LINE)))
    return docs.select("doc_id", T.document_role(F.col("source"), F.array_join(F.slice(lines, 1, 40), " "), asked).alias("role"))


@query("""WITH s AS (SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'file') AS base FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS r FROM s) SELECT p_partkey, CASE WHEN r = 1 THEN base ELSE base || '_' || r END AS id FROM k""")
def slug_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable ids without collisions: base, base_2, base_3."""
    rows = table(spark, sf_dir, "part").select("p_partkey", T.slug(F.concat_ws(" ", "p_name", "p_type")).alias("base"))
    r = F.row_number().over(Window.partitionBy("base").orderBy("p_partkey"))
    return rows.withColumn("r", r).select("p_partkey", F.when(F.col("r") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", "r")).alias("id"))


@query(f"""WITH k AS (SELECT doc_id, array_to_string(({tok_sql("string_split(text, chr(10))[1]")})[1:12], ' ') AS k FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY k) AS latest, count(*) OVER (PARTITION BY k) AS n FROM k WHERE k <> ''""")
def key_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest document that shares each document's first twelve tokens."""
    first = F.substring_index("text", "\n", 1)
    keyed = table(spark, sf_dir, "documents").select("doc_id", T.line_key(T.tokens(first, False)).alias("k")).where("k <> ''")
    latest = keyed.groupBy("k").agg(F.max("doc_id").alias("latest"), F.count("*").alias("n"))
    return keyed.join(latest, "k").select("doc_id", "latest", "n")




@query("""SELECT conv_id, turn, asked FROM (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked FROM conversations) WHERE role = 'assistant'""")
def last_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's last turn before each answer."""
    turns = table(spark, sf_dir, "conversations")
    return validate.carry_forward(turns, ["conv_id"], "turn", F.col("role") == "user", F.col("turn"), "asked").where("role = 'assistant'").select("conv_id", "turn", "asked")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def pk_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines whose key isn't unique."""
    return validate.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT 'lineitem.order' AS rule, l_orderkey::VARCHAR AS subject FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT 'order.customer', o_custkey::VARCHAR FROM orders ANTI JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'document.label', doc_id::VARCHAR FROM documents ANTI JOIN labels USING (doc_id)""")
def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys without the row they refer to."""
    read = lambda name: table(spark, sf_dir, name)
    parts = [("lineitem.order", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("order.customer", "orders", "o_custkey", "customer", "c_custkey"), ("document.label", "documents", "doc_id", "labels", "doc_id")]
    out = [validate.orphans(read(c).select(k), k, read(p), pk).select(F.lit(rule).alias("rule"), F.col(k).cast("string").alias("subject")) for rule, c, k, p, pk in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""SELECT rule, l_orderkey::VARCHAR AS subject, n FROM (SELECT rule, l_orderkey, count(*) AS n FROM (
SELECT 'quantity' AS rule, l_orderkey FROM lineitem WHERE NOT coalesce(l_quantity BETWEEN 1 AND 45, false)
UNION ALL SELECT 'discount', l_orderkey FROM lineitem WHERE NOT coalesce(l_discount <= 0.09, false)
UNION ALL SELECT 'flag', l_orderkey FROM lineitem WHERE NOT coalesce(l_returnflag IN ('A', 'N'), false)
UNION ALL SELECT 'ship', l_orderkey FROM lineitem WHERE NOT coalesce(l_shipdate >= TIMESTAMP '1993-01-01', false)) GROUP BY ALL)""")
def domain_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines that break domain rules, counted for each order."""
    rules: dict[str, Column] = {
        "quantity": F.col("l_quantity").between(1, 45), "discount": F.col("l_discount") <= 0.09,
        "flag": F.col("l_returnflag").isin("A", "N"), "ship": F.col("l_shipdate") >= F.lit("1993-01-01").cast("timestamp")}
    return validate.violations(table(spark, sf_dir, "lineitem"), rules, F.col("l_orderkey")).groupBy("rule", "subject").agg(F.count("*").alias("n"))


@query("""SELECT n_nationkey, coalesce(n, 0)::BIGINT AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'none' WHEN n < 8 THEN 'few' ELSE 'enough' END AS status
FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY ALL) ON n_nationkey = s_nationkey""")
def unit_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of each nation, zero filled, and whether they are few."""
    return validate.coverage(table(spark, sf_dir, "nation"), "n_nationkey", table(spark, sf_dir, "supplier"), "s_nationkey", 8)


@query("SELECT o_orderpriority, count(*) AS n, count(*) / (SELECT count(*) FROM orders) AS share FROM orders GROUP BY o_orderpriority")
def class_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each priority and their share."""
    return validate.mix(table(spark, sf_dir, "orders"), "o_orderpriority")


_TOTALS = """t AS (SELECT l_orderkey AS o_orderkey, sum(l_extendedprice::DECIMAL(18, 2))::DOUBLE AS lines FROM lineitem GROUP BY ALL),
bad AS (SELECT o_orderkey, lines, o_totalprice AS stated FROM orders JOIN t USING (o_orderkey)
WHERE NOT (abs(lines - o_totalprice) <= greatest(0.005::DOUBLE * abs(o_totalprice), 1e-9::DOUBLE) OR abs(lines * 100 - o_totalprice) <= greatest(0.005::DOUBLE * abs(o_totalprice), 1e-9::DOUBLE)))"""


def _wrong_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("lines"))
    stated = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("stated"))
    return validate.disagreements(stated.join(lines, "o_orderkey"), "lines", "stated", P.CALC_TOLERANCE).select("o_orderkey", "lines", "stated")


@query(f"WITH {_TOTALS} SELECT * FROM bad")
def tolerance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose stated total isn't within half a percent of their lines'."""
    return _wrong_totals(spark, sf_dir)


_RISK = f"""WITH {_TOTALS}, r AS (SELECT DISTINCT l_orderkey AS o_orderkey, CASE l_returnflag WHEN 'R' THEN 'table' WHEN 'A' THEN 'figure' ELSE 'MCQ' END AS reason FROM lineitem),
soft AS (SELECT o_orderkey, sum(CASE reason WHEN 'table' THEN 2.0 WHEN 'figure' THEN 1.0 ELSE 0.5 END)::DOUBLE AS soft FROM r GROUP BY ALL), hard AS (SELECT o_orderkey, count(*) AS errors FROM bad GROUP BY ALL),
s AS (SELECT coalesce(soft.o_orderkey, hard.o_orderkey) AS o_orderkey, coalesce(errors, 0)::BIGINT AS errors, coalesce(errors, 0) * 10.0::DOUBLE + coalesce(soft, 0.0::DOUBLE) AS score FROM soft FULL JOIN hard ON soft.o_orderkey = hard.o_orderkey)"""


def _risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    reasons = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(flag == "R", "table").when(flag == "A", "figure").otherwise("MCQ").alias("reason"))
    return validate.risk_scores(_wrong_totals(spark, sf_dir), reasons, ["o_orderkey"], P.RISK_WEIGHTS)


@query(_RISK + " SELECT * FROM s")
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk of each order: ten for a wrong total and each distinct reason's weight."""
    return _risk(spark, sf_dir)


@query(_RISK + " SELECT * FROM s ORDER BY score DESC, o_orderkey LIMIT 8")
def riskiest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight orders to review first."""
    return validate.first_rows(_risk(spark, sf_dir), 8, F.col("score").desc(), F.col("o_orderkey"))


@query(f"WITH {_CONTAIN}, best AS (SELECT item_id, coalesce(max(hits), 0) / any_value(total) AS precision FROM tot LEFT JOIN pairs USING (item_id) GROUP BY item_id) SELECT item_id, precision FROM best ORDER BY precision, item_id LIMIT 3")
def lowest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three benchmark items that documents hold least of."""
    bench = table(spark, sf_dir, "benchmark")
    pairs = C.containment(bench, table(spark, sf_dir, "documents"), "item_id", "doc_id", threshold=0.0, exact=False)
    best = pairs.groupBy("item_id").agg(F.max("precision").alias("p"))
    items_ = C.gram_rows(bench, ["item_id"], "text", exact=False).select("item_id").distinct()
    scored = items_.join(best, "item_id", "left").select("item_id", F.coalesce("p", F.lit(0.0)).alias("precision"))
    return validate.first_rows(scored, 3, F.col("precision"), F.col("item_id"))


@query("""WITH RECURSIVE a AS (SELECT conv_id AS graph, list(length(text)::DOUBLE ORDER BY turn) AS d, list(turn ORDER BY turn) AS id FROM conversations GROUP BY conv_id),
e AS (SELECT graph, d, id, 0 AS i, []::DOUBLE[] AS ef FROM a UNION ALL SELECT graph, d, id, i + 1, list_append(ef, d[i + 1] + greatest(coalesce(CASE WHEN i > 1 THEN ef[i - 1] END, 0), coalesce(CASE WHEN i > 2 THEN ef[i - 2] END, 0))) FROM e WHERE i < len(d)),
f AS (SELECT graph, d, id, ef, list_max(ef) AS total FROM e WHERE i = len(d)),
l AS (SELECT graph, d, id, ef, total, 0 AS i, []::DOUBLE[] AS tail FROM f
  UNION ALL SELECT graph, d, id, ef, total, i + 1, list_append(tail, d[len(d) - i] + greatest(coalesce(CASE WHEN i > 1 THEN tail[i - 1] END, 0), coalesce(CASE WHEN i > 2 THEN tail[i - 2] END, 0))) FROM l WHERE i < len(d)),
r AS (SELECT graph, total, unnest(id) AS id, unnest(d) AS d, unnest(ef) AS ef, unnest(list_reverse(tail)) AS tail FROM l WHERE i = len(d))
SELECT graph, id, d, ef - d AS es, ef, total - tail AS ls, total - tail + d AS lf, abs(total - tail - (ef - d)) < 1e-9 AS critical FROM r""")
def critical_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earliest and latest times of turns, each after those two and three before it."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("graph"), F.col("turn").alias("id"), F.length("text").alias("d"))
    needs = turns.select("graph", "id", F.explode(F.array(F.col("id") - 2, F.col("id") - 3)).alias("pred"))
    return graph.critical_path(turns, needs.join(turns.select("graph", F.col("id").alias("pred")), ["graph", "pred"]))


@query(f"""WITH RECURSIVE k AS (SELECT doc_id, array_to_string(({tok_sql("string_split(text, chr(10))[1]")})[1:12], ' ') AS k, md5(text) AS h FROM documents),
e AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY k) AS b FROM k WHERE len(string_split(k, ' ')) >= 6 UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY h) FROM k),
s AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
r AS (SELECT DISTINCT a AS node, a AS reach FROM s UNION SELECT r.node, s.b FROM r JOIN s ON r.reach = s.a)
SELECT node, min(reach) AS component FROM r GROUP BY node""")
def dup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share their text or the start of their first line, directly or through others."""
    docs = table(spark, sf_dir, "documents")
    toks = T.tokens(F.substring_index("text", "\n", 1), False)
    keyed = docs.select("doc_id", F.when(F.size(toks) >= 6, T.line_key(toks)).alias("k"), F.md5("text").alias("h"))

    def stars(key: str) -> DataFrame:
        rows = keyed.where(F.col(key).isNotNull())
        return rows.join(rows.groupBy(key).agg(F.min("doc_id").alias("b")), key).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")

    return graph.connected_components(stars("k").unionByName(stars("h")))


@query("SELECT d.doc_id, n_chars, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, -1) AS toxic FROM (SELECT doc_id, n_chars FROM documents) d LEFT JOIN labels l USING (doc_id)")
def merge_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with what people said about them carried over."""
    new = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.lit(0).alias("quality"))
    return sinks.merge_fields(new, table(spark, sf_dir, "labels"), "doc_id", ["doc_id", "n_chars"]).fillna({"toxic": -1})


@query("SELECT min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def content_hash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with one content, by its hash."""
    hashed = table(spark, sf_dir, "documents").select("doc_id", T.content_hash("text").alias("h"))
    return hashed.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("first_id", "n")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT o_orderkey, 'X', o_totalprice FROM orders WHERE o_orderkey % 10 = 0")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth order replaced by a newer row of its key."""
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return sinks.upsert(old, old.where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X")), "o_orderkey")


@query(f"WITH d AS (SELECT doc_id, {tok_sql('text')} AS t FROM documents) SELECT doc_id, pos::INTEGER AS pos, word FROM (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) - 1 AS pos FROM d) ANTI JOIN (SELECT DISTINCT unnest({tok_sql('text')}) AS word FROM benchmark) USING (word)")
def unknown_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that no benchmark item has."""
    vocabulary = table(spark, sf_dir, "benchmark").select(F.explode(T.tokens("text", False)).alias("word"))
    return C.unknown_words(table(spark, sf_dir, "documents"), vocabulary, ["doc_id"], exact=False).select("doc_id", "pos", "word")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of events' JSON."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))
