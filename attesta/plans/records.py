"""Queries over records, sinks, readers and small formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from attesta.functions import patterns as P, text as T
from attesta.operators import items as I, review, validate
from attesta.plans import fidelity
from attesta.plans.papers import LINES, SPANS, made, records, spans
from attesta.plans.registry import query, tok_sql
from attesta.session import materialise, scratch_dir, table
from attesta.sources import markup, sinks


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


# ---- texts and formats

_WRAPPED = "CASE item_id % 3 WHEN 0 THEN '**' || text || '**' WHEN 1 THEN '*' || text || '* & <b>' ELSE 'a * b ' || text END"


@query(f"""WITH t AS (SELECT item_id, replace(replace(replace({_WRAPPED.replace('text', "replace(text, chr(10), ' ')")}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t FROM benchmark)
SELECT item_id, CASE item_id % 3 WHEN 0 THEN '<b>' || t[3:-3] || '</b>' WHEN 1 THEN '<em>' || split_part(t[2:], '* &amp;', 1) || '</em> &amp;' || split_part(t[2:], '* &amp;', 2) ELSE t END AS text FROM t""")
def inline_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items with bold or italic marks as inline HTML."""
    k, text = F.col("item_id") % 3, F.replace("text", F.lit("\n"), F.lit(" "))
    wrapped = F.when(k == 0, F.concat(F.lit("**"), text, F.lit("**"))).when(k == 1, F.concat(F.lit("*"), text, F.lit("* & <b>"))).otherwise(F.concat(F.lit("a * b "), text))
    return table(spark, sf_dir, "benchmark").select("item_id", T.escape_inline(wrapped).alias("text"))


@query("""SELECT p_partkey, try_cast(replace(t, ',', '') AS DOUBLE) AS value, abs(p_retailprice - round(p_retailprice)) <= greatest(0.005::DOUBLE * abs(round(p_retailprice)), 1e-9::DOUBLE) AS near,
try_cast(replace(replace(nullif(regexp_extract(o, '[-−]?\\d[\\d,]*(?:\\.\\d+)?'), ''), '−', '-'), ',', '') AS DOUBLE) AS first, CASE WHEN p_size % 2 = 0 THEN '=_xlfn.NORM.S.INV(' || p_size || ')+SUM(1)' ELSE 'NORM.S.INV(' || p_size || ')' END AS formula
FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN format('{:,}', p_partkey * 1000 + p_size) WHEN 1 THEN p_name ELSE p_size || '.5' END AS t, CASE p_partkey % 3 WHEN 0 THEN 'about −' || p_size || '.25 units' WHEN 1 THEN p_name ELSE '1,' || (100 + p_size) || ' of 7' END AS o FROM part)""")
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers read from texts, compared, found in options, and spreadsheet functions as files need them."""
    k, size = F.col("p_partkey") % 3, F.col("p_size")
    t = F.when(k == 0, F.format_number(F.col("p_partkey") * 1000 + size, 0)).when(k == 1, F.col("p_name")).otherwise(F.concat(size, F.lit(".5")))
    o = F.when(k == 0, F.concat(F.lit("about −"), size, F.lit(".25 units"))).when(k == 1, F.col("p_name")).otherwise(F.concat(F.lit("1,"), 100 + size, F.lit(" of 7")))
    formula = F.concat(F.when(size % 2 == 0, "=").otherwise(""), F.lit("NORM.S.INV("), size, F.lit(")"), F.when(size % 2 == 0, "+SUM(1)").otherwise(""))
    return table(spark, sf_dir, "part").select(
        "p_partkey", T.parse_number(t).alias("value"), T.close_to(F.col("p_retailprice"), F.round("p_retailprice")).alias("near"), T.first_number(o).alias("first"), T.prefix_functions(formula).alias("formula"))


@query("""WITH v AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 1000.0::DOUBLE WHEN 1 THEN p_size + 1000.125::DOUBLE WHEN 2 THEN p_size + 0.5::DOUBLE ELSE NULL END AS v, p_size AS span FROM part)
SELECT p_partkey, CASE WHEN v IS NULL THEN '' WHEN v = floor(v) THEN format('{:,}', v::BIGINT) WHEN v >= 1000 THEN format('{:,.2f}', v) ELSE v::VARCHAR END AS shown,
(SELECT min(m * pow(10, floor(log10(span / 5.0::DOUBLE)))) FROM (VALUES (1.0::DOUBLE), (2.0), (2.5), (5.0), (10.0)) s(m) WHERE m * pow(10, floor(log10(span / 5.0::DOUBLE))) >= span / 5.0::DOUBLE) AS step FROM v""")
def shown_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as people read them, and steps of axes."""
    k, size = F.col("p_partkey") % 4, F.col("p_size")
    v = F.when(k == 0, size * 1000.0).when(k == 1, size + 1000.125).when(k == 2, size + 0.5)
    return table(spark, sf_dir, "part").select("p_partkey", T.display_number(v).alias("shown"), T.tick_step(F.lit(0.0), size.cast("double")).alias("step"))


@query(f"""WITH t AS (SELECT doc_id, regexp_replace(replace(replace(replace(regexp_replace(html, '{P.TAG}', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g') AS t FROM (SELECT page_id AS doc_id, html FROM pages)),
p AS (SELECT doc_id AS page_id, replace(replace(t, '**', ' '), chr(9), ' ') AS text FROM t)
SELECT page_id, text, len({tok_sql('text')})::INTEGER AS n_tokens, len(list_filter({tok_sql('text')}, lambda x: regexp_matches(x, '^\\d')))::INTEGER AS n_numbers FROM p""")
def html_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as plain text with entities decoded, their token count, and how many are numbers."""
    rows = table(spark, sf_dir, "pages").select("page_id", T.plain("html").alias("text"))
    toks = T.tokens("text")
    return rows.select("page_id", "text", F.size(toks).alias("n_tokens"), F.size(T.numbers(toks)).alias("n_numbers"))


_LABELLED = "CASE item_id % 3 WHEN 0 THEN '(A) ' || a || ' (B) ' || b || ' (C) ' || c WHEN 1 THEN '(b) ' || a || ' (A) ' || b ELSE a || ' ' || b END"


@query(f"""WITH w AS (SELECT item_id, split_part(text, ' ', 1) AS a, split_part(text, ' ', 2) AS b, split_part(text, ' ', 3) AS c FROM benchmark), t AS (SELECT item_id, {_LABELLED} AS t FROM w)
SELECT item_id, CASE WHEN len(regexp_extract_all(t, '{P.INLINE_LABEL}')) >= 3 THEN regexp_replace(t, '{P.INLINE_LABEL}', ' ', 'g') ELSE regexp_replace(t, '{P.OPTION_LABEL}', '') END AS text FROM t""")
def bare_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without their option labels."""
    a, b, c = (F.get(F.split("text", " "), i) for i in range(3))
    k = F.col("item_id") % 3
    t = F.when(k == 0, F.concat(F.lit("(A) "), a, F.lit(" (B) "), b, F.lit(" (C) "), c)).when(k == 1, F.concat(F.lit("(b) "), a, F.lit(" (A) "), b)).otherwise(F.concat_ws(" ", a, b))
    return table(spark, sf_dir, "benchmark").select("item_id", T.unlabelled(t).alias("text"))


_PATTERNED = """p AS (SELECT item_id, unnest(['Page ' || item_id || ' of 9', '- ' || item_id || ' -', 'Q. ' || item_id % 50 || ') ' || text, 'Section ' || 'A ' || item_id, 'IV. ' || text, '(b) ' || text, 'iii) ' || text, 'C. ' || text, text || ' [' || item_id || ' marks]', 'Answer: ' || text, text, 'The other questions are straightforward', '(D) because ' || text, 'D.']) AS t FROM (SELECT item_id, replace(text, chr(10), ' ') AS text FROM benchmark))"""
_FORMS = ("PAGE_NUMBER", "QUESTION_START", "QUESTION_WORD", "SECTION", "OPTION", "SUBPART", "ROMAN_SUBPART", "PART_LABEL", "MARKS", "ANSWER_HINT", "SOLUTION_NOTE")


@query("WITH " + _PATTERNED + " SELECT item_id, t, " + ", ".join(f"regexp_matches(t, '{getattr(P, f).replace('(?=' + chr(92) + 'S)', chr(92) + 'S')}') AS {f.lower()}" for f in _FORMS) + " FROM p")
def printed_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which printed forms lines made from benchmark items have."""
    i, text = F.col("item_id"), F.col("text")
    join = lambda *x: F.concat(*(F.lit(c) if isinstance(c, str) else c for c in x))
    lines = F.array(
        join("Page ", i, " of 9"), join("- ", i, " -"), join("Q. ", i % 50, ") ", text), join("Section A ", i), join("IV. ", text), join("(b) ", text), join("iii) ", text), join("C. ", text), join(text, " [", i, " marks]"), join("Answer: ", text), text,
        F.lit("The other questions are straightforward"), join("(D) because ", text), F.lit("D."))
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text")).select("item_id", F.explode(lines).alias("t"))
    return rows.select("item_id", "t", *(F.col("t").rlike(getattr(P, f)).alias(f.lower()) for f in _FORMS))


@query("""SELECT p_partkey, CASE WHEN len(m) > 0 THEN list_sum(list_transform(m, lambda x: x::DOUBLE)) END AS marks
FROM (SELECT p_partkey, regexp_extract_all(t, '(?i)[\\[(]\\s*(\\d+(?:\\.\\d+)?)\\s*marks?\\s*[\\])]', 1) AS m FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_name || ' [' || p_size || ' Marks] and (' || printf('%.1f', p_size / 2.0) || ' mark) [x marks]' END AS t FROM part))""")
def marks_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks printed in texts made from parts."""
    half = F.format_string("%.1f", F.col("p_size") / 2)
    text = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.col("p_name"), F.lit(" ["), F.col("p_size"), F.lit(" Marks] and ("), half, F.lit(" mark) [x marks]")))
    return table(spark, sf_dir, "part").select("p_partkey", T.marks_total(text).alias("marks"))


_MATHS = """CASE WHEN p_partkey % 2 = 0 THEN p_name || ' ' ELSE '' END || array_to_string(list_transform(range(1, 1 + p_size % 5), lambda i: CASE (p_partkey * 7 + i * p_size) % 6 WHEN 0 THEN '\\(x' WHEN 1 THEN 'y\\)' WHEN 2 THEN '\\[z' WHEN 3 THEN '\\]' WHEN 4 THEN 'plain' ELSE '$a \\times b$' END), ' ')"""


@query(f"""WITH RECURSIVE t AS (SELECT p_partkey, {_MATHS} AS t FROM part), m AS (SELECT p_partkey, t, regexp_extract_all(t, '\\\\[()\\[\\]]') AS m FROM t),
s AS (SELECT p_partkey, t, m, 0 AS i, '' AS open, NULL::VARCHAR AS fault FROM m
  UNION ALL SELECT p_partkey, t, m, i + 1, CASE WHEN m[i + 1] IN ('\\(', '\\[') THEN m[i + 1] ELSE '' END,
  coalesce(fault, CASE WHEN m[i + 1] IN ('\\(', '\\[') THEN CASE WHEN open <> '' THEN 'nested' END WHEN open = '' THEN 'without opener' WHEN m[i + 1] <> CASE open WHEN '\\(' THEN '\\)' ELSE '\\]' END THEN 'closed by another' END) FROM s WHERE i < len(m))
SELECT p_partkey, CASE WHEN len(m) > 0 THEN coalesce(fault, CASE WHEN open <> '' THEN 'never closed' END) WHEN regexp_matches(t, '\\$[^$\\s][^$]*\\\\[a-zA-Z]+[^$]*\\$') THEN 'dollars' END AS fault FROM s WHERE i = len(m)""")
def math_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of maths delimiters in texts with up to four of them in any order."""
    kind = F.array(*(F.lit(x) for x in ("\\(x", "y\\)", "\\[z", "\\]", "plain", "$a \\times b$")))
    n = F.col("p_size") % 5
    marks = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.get(kind, ((F.col("p_partkey") * 7 + i * F.col("p_size")) % 6).cast("int")))).otherwise(F.array().cast("array<string>"))
    text = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" "))).otherwise(""), F.array_join(marks, " "))
    return table(spark, sf_dir, "part").select("p_partkey", T.math_state(text).alias("fault"))


@query("""SELECT s.s_suppkey, p.p_partkey, floor(CASE WHEN greatest(w, h) > 1568 THEN (w * 1568 / greatest(w, h)) * (h * 1568 / greatest(w, h)) ELSE w * h END / 750 + 1e-9::DOUBLE)::INTEGER AS tokens
FROM (SELECT s_suppkey, 100.0::DOUBLE * (1 + s_suppkey % 40) AS w FROM supplier) s JOIN (SELECT p_partkey, 75.0::DOUBLE * p_size AS h FROM part WHERE p_partkey % 10 = 0) p ON true""")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of images of suppliers' widths and every tenth part's heights."""
    w = table(spark, sf_dir, "supplier").select("s_suppkey", (100.0 * (1 + F.col("s_suppkey") % 40)).alias("w"))
    h = table(spark, sf_dir, "part").where("p_partkey % 10 = 0").select("p_partkey", (75.0 * F.col("p_size")).alias("h"))
    # A small file is one split, but each of its rows makes as many as there are suppliers: it is dealt out first.
    return h.repartition(4 * spark.sparkContext.defaultParallelism).crossJoin(F.broadcast(w)).select("s_suppkey", "p_partkey", T.image_tokens("w", "h").alias("tokens"))


# ---- records

_QUESTIONS = "qs AS (SELECT conv_id, turn, 'q' || conv_id || '-' || turn AS id, text, conv_id % 3 = 0 AS open, turn AS n, role = 'user' AS head FROM conversations)"


def _bank(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Items of conversations (users' turns are headings) and questions that refer to the next but one turn of each."""
    turns = table(spark, sf_dir, "conversations")
    items = turns.select(F.col("conv_id").cast("string").alias("paper"), F.col("turn").alias("n"), F.concat(F.lit("Question "), "turn").alias("name"), F.col("text").alias("q"), (F.col("role") == "user").alias("head"))
    return turns.select("conv_id", "turn", F.col("conv_id").cast("string").alias("ref_paper"), (F.col("turn") + 2).alias("ref_n")), items


@query("""SELECT q.conv_id, q.turn, i.text AS item_q, (SELECT h.text FROM conversations h WHERE h.conv_id = q.conv_id AND h.turn < q.turn + 2 AND h.role = 'user' AND i.text IS NOT NULL ORDER BY h.turn DESC LIMIT 1) AS head_q
FROM conversations q LEFT JOIN conversations i ON i.conv_id = q.conv_id AND i.turn = q.turn + 2 AND i.role <> 'user'""")
def bank_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the item they refer to and the last heading before it."""
    questions, items = _bank(spark, sf_dir)
    return fidelity.expand_refs(questions, items).select("conv_id", "turn", "item_q", "head_q")


@query("""WITH p AS (SELECT conv_id, turn, text, role = 'user' AS head, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS k, row_number() OVER (PARTITION BY conv_id, chr((97 + turn % 3)::INTEGER) ORDER BY turn) AS r, '(' || chr((97 + turn % 3)::INTEGER) || ')' AS label FROM conversations),
x AS (SELECT DISTINCT conv_id, part FROM conversations, (VALUES ('1'), ('3'), ('(b)'), ('(z)')) v(part)),
f AS (SELECT x.conv_id, x.part, coalesce(a.k, b.k) AS place FROM x LEFT JOIN p a ON a.conv_id = x.conv_id AND a.k = try_cast(x.part AS INTEGER) LEFT JOIN p b ON b.conv_id = x.conv_id AND b.label = x.part AND b.r = 1)
SELECT f.conv_id, f.part, f.place, p.text AS part_q, (SELECT h.text FROM p h WHERE h.conv_id = f.conv_id AND h.k < f.place AND h.head ORDER BY h.k DESC LIMIT 1) AS passage FROM f LEFT JOIN p ON p.conv_id = f.conv_id AND p.k = f.place""")
def shown_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples with the part they show, by its place or its label, and the passage before it."""
    turns = table(spark, sf_dir, "conversations")
    label = F.concat(F.lit("("), F.char(97 + F.col("turn") % 3), F.lit(")"))
    strings = "array<string>"
    part = F.struct("turn", F.struct(
        label.alias("label"), (F.col("role") == "user").alias("head"), F.col("text").alias("q"), _null(strings).alias("o"), _null(strings).alias("choices"), _null("int").alias("a"), _null("array<double>").alias("num"), _null("string").alias("official"),
        _null("string").alias("e"), _null(fidelity.MEDIA).alias("media")).alias("p"))
    items = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", part["p"]["label"].alias("label"), part["p"]["head"].alias("head"), "text"))), lambda x: F.struct(
        x["label"].alias("label"), x["head"].alias("head"), x["text"].alias("q"), _null(strings).alias("o"), _null(strings).alias("choices"), _null("int").alias("a"), _null("array<double>").alias("num"), _null("string").alias("official"),
        _null("string").alias("e"), _null(fidelity.MEDIA).alias("media"))).alias("parts"))
    items = items.select(F.col("conv_id").alias("paper"), F.lit(1).alias("n"), F.lit("").alias("q"), "parts")
    examples = items.select("paper", "n", F.explode(F.array(*(F.lit(x) for x in ("1", "3", "(b)", "(z)")))).alias("part"))
    return fidelity.expand_examples(examples, items).select(F.col("paper").alias("conv_id"), "part", "place", "part_q", "passage")


@query("""WITH f AS (SELECT DISTINCT source AS id FROM documents), p AS (SELECT source AS id, count(*) AS pages, list_sort(list(DISTINCT lang)) AS m FROM documents GROUP BY ALL),
v AS (SELECT source AS id, count(*) AS images, sum(n_chars // 4)::BIGINT AS tokens FROM documents WHERE doc_id % 3 = 0 GROUP BY ALL)
SELECT id, 'paper' AS role, pages, array_to_string(m, '/') AS modes, coalesce(images, 0)::BIGINT AS images, coalesce(tokens, 0)::BIGINT AS tokens FROM f JOIN p USING (id) LEFT JOIN v USING (id)
UNION ALL SELECT 'no pages', 'reading', 0, 'text', 0, 0""")
def file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each source: documents as pages, languages as modes, and what images of every third cost."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.col("source").alias("id"), F.lit("paper").alias("role")).distinct().unionByName(spark.createDataFrame([("no pages", "reading")], "id string, role string"))
    views = docs.where("doc_id % 3 = 0").select(F.col("source").alias("id"), F.floor(F.col("n_chars") / 4).alias("tokens"))
    return review.summary(files, docs.select(F.col("source").alias("id"), F.col("lang").alias("mode")), views)


@query("""WITH s AS (SELECT DISTINCT source AS id, regexp_extract(source, '\\d+')::INTEGER AS no FROM documents)
SELECT p.id, coalesce(string_agg(s.id, ' ' ORDER BY s.id), '') AS solutions FROM s p LEFT JOIN s ON s.no % 2 = 1 AND p.no = s.no // 4 * 2 WHERE p.no % 2 = 0 GROUP BY p.id""")
def solution_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with an even number as papers, and the odd ones that are paired with each."""
    no = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    prefix = F.regexp_replace("source", r"\d+", "")
    files = table(spark, sf_dir, "documents").select("source").distinct().select(F.col("source").alias("id"), F.when(no % 2 == 1, "solution").otherwise("paper").alias("role"), F.when(no % 2 == 1, F.concat(prefix, F.floor(no / 4) * 2)).alias("pair"))
    return review.solutions_of(files).select("id", F.array_join("solutions", " ").alias("solutions"))


@query("""WITH b AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') || CASE WHEN p_partkey % 10 = 0 THEN '_2' ELSE '' END AS base FROM part),
t AS (SELECT DISTINCT base AS id FROM b UNION SELECT 'red_bolt_3'), g AS (SELECT base, count(*) AS n FROM b GROUP BY base),
c AS (SELECT base, k, CASE WHEN k = 1 THEN base ELSE base || '_' || k END AS id FROM g, range(1, 2000) r(k) WHERE k <= n + 60),
f AS (SELECT base, id, row_number() OVER (PARTITION BY base ORDER BY k) AS r FROM c WHERE (k = 1 OR id NOT IN (SELECT id FROM t)) AND id <> 'red_bolt_3'),
o AS (SELECT p_partkey, base, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS r FROM b)
SELECT p_partkey, id FROM o JOIN f USING (base, r)""")
def dealt_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable ids that step over names which others have already."""
    name = F.concat("p_name", F.when(F.col("p_partkey") % 10 == 0, " 2").otherwise(""))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    return review.unique_ids(rows, "name", "p_partkey", spark.createDataFrame([("red_bolt_3",)], "id string")).select("p_partkey", "id")


@query("""WITH j AS (SELECT c.conv_id, c.turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations c)
SELECT conv_id, 'papers[' || i || '].role' AS path, role AS text, 'paper ' || (i + 1) || '.role' AS label FROM j UNION ALL SELECT conv_id, 'papers[' || i || '].qs[0].q', text, 'paper ' || (i + 1) || '.qs[0].q' FROM j
UNION ALL SELECT DISTINCT conv_id, 'title', 'Conversation ' || conv_id, 'title' FROM conversations""")
def json_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every string of nested records with its path, private fields left out."""
    turn = F.struct("turn", "role", F.array(F.struct(F.col("text").alias("q"), F.lit("hidden").alias("_key"), F.lit("hidden").alias("src"), F.lit(3).alias("n"))).alias("qs"), F.lit("hidden").alias("e_src"))
    papers = F.transform(F.array_sort(F.collect_list(turn)), lambda x: F.struct(x["role"].alias("role"), x["qs"].alias("qs"), x["e_src"].alias("e_src")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(papers.alias("papers")).select("conv_id", F.to_json(F.struct(F.concat(F.lit("Conversation "), "conv_id").alias("title"), "papers")).alias("j"))
    found = review.flatten_json(rows, "conv_id", "j")
    return found.select("conv_id", "path", "text", review.where_of(F.col("path")).alias("label"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', '_') || ' bad name' ELSE 'bad name' END AS bad FROM part")
def macro_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of macros that aren't a backslash and letters."""
    size = F.col("p_size")
    first = F.when(size % 2 == 0, F.replace("p_name", F.lit(" "), F.lit("_"))).otherwise(F.concat(F.lit("\\"), F.split_part("p_name", F.lit(" "), F.lit(1))))
    macros = F.create_map(first, F.lit("x"), F.lit("bad name"), F.lit("y"), F.lit("\\good"), F.lit("z"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(review.bad_macros(macros), " ").alias("bad"))


@query("SELECT event_id, event_type FROM events WHERE event_type IN (SELECT event_type FROM (SELECT DISTINCT event_type FROM events) ORDER BY event_type LIMIT 2)")
def chosen_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the first two types, which stand for two sections that were chosen by other names."""
    events = table(spark, sf_dir, "events")
    kinds = [r["event_type"] for r in events.select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    names = dict(zip(review.chosen_sections("quiz, notes quiz"), kinds, strict=True))
    return fidelity.in_sections(events, "event_type", list(names.values())).select("event_id", "event_type")


@query("SELECT doc_id, 'q ' || lang AS q, source AS part_q FROM documents")
def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without private fields at any depth."""
    part = F.struct(F.col("source").alias("q"), F.lit("hidden").alias("src_id"), F.lit("hidden").alias("_k"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("q "), "lang").alias("q"), F.lit("hidden").alias("source"), F.lit(1).alias("lo"), F.lit(2).alias("_seen"), F.array(part).alias("parts"))
    open_ = fidelity.without_private(rows)
    assert open_.columns == ["doc_id", "q", "parts"] and open_.schema["parts"].dataType.elementType.names == ["q"]
    return open_.select("doc_id", "q", F.get("parts", 0)["q"].alias("part_q"))


@query("""SELECT p_partkey AS id, p_size % 4 = 1 AS ragged, p_size % 3 = 1 AS spans_differ FROM part WHERE p_size % 4 = 1 OR p_size % 3 = 1""")
def table_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables whose rows aren't as wide as their head, or whose groups don't span it."""
    size, name = F.col("p_size"), F.split("p_name", " ")
    row = F.when(size % 4 == 1, F.array("p_brand")).otherwise(F.array("p_brand", "p_type"))
    spans_ = F.when(size % 3 == 1, F.array(F.lit(1))).when(size % 3 == 2, F.array(F.lit(1), F.lit(1)))
    return review.table_shape(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.slice(F.concat(name, F.array(F.lit("x"))), 1, 2).alias("head"), F.array(row, F.array("p_type", "p_brand")).alias("rows"), spans_.alias("spans")))


@query("""SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'unknown type' WHEN 1 THEN 'not pairs' ELSE 'no title' END AS fault FROM part WHERE p_size % 5 IN (0, 1) OR (p_size % 5 = 2 AND p_size % 2 = 0)""")
def block_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of unknown types, definitions that aren't pairs, boxes without a title."""
    k = F.col("p_size") % 5
    t = F.when(k == 0, F.lower("p_type")).when(k.isin(1, 3), "defs").when(k == 2, "box").otherwise("flow")
    pairs = F.when(k == 1, F.array(F.array("p_name"))).when(k == 3, F.array(F.array("p_name", "p_type")))
    return review.block_faults(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), t.alias("t"), F.when(F.col("p_size") % 2 == 1, F.col("p_name")).alias("title"), pairs.alias("pairs")))


@query("""SELECT l_orderkey, l_linenumber, l_quantity AS b1, l_extendedprice AS b2, l_extendedprice / l_quantity AS b3, sqrt(l_quantity * 2) AS b4, greatest(l_quantity, 10.0) AS b5, -l_quantity * l_quantity AS b6, NULL::DOUBLE AS b7 FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice, l_quantity, l_partkey, l_suppkey) = 1""")
def workings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of cells with formulas, made from order lines (the first row of each key)."""
    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_extendedprice", "l_quantity", "l_partkey", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(first)).where("r = 1")
    cells = F.array(F.col("l_quantity").cast("string"), F.col("l_extendedprice").cast("string"), *(F.lit(x) for x in ("=B2/B1", "=SQRT(B1*2)", "=MAX(B1,10)", "=-B1^2", "=B9+1")))
    found = review.workings(lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), cells.alias("cells")))
    parts = F.split("id", "-")
    return found.select(parts[0].cast("long").alias("l_orderkey"), parts[1].cast("int").alias("l_linenumber"), *(F.col("values")[i].alias(f"b{i + 1}") for i in range(7)))


_LINES_OF = "t AS (SELECT l_orderkey AS id, sum(l_extendedprice::DECIMAL(18, 2))::DOUBLE AS v FROM lineitem GROUP BY ALL)"


def _calcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("value"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("stated")).join(lines, "id", "left")


def _near_sql(v: str, e: str, tol: str = "0.005::DOUBLE") -> str:
    return f"coalesce(abs({v} - {e}) <= greatest({tol} * abs({e}), 1e-9::DOUBLE) OR abs({v} * 100 - {e}) <= greatest({tol} * abs({e}), 1e-9::DOUBLE), false)"


@query(f"""WITH {_LINES_OF}, c AS (SELECT o_orderkey AS id, v AS value, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS expected, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS official FROM orders LEFT JOIN t ON id = o_orderkey)
SELECT id, value, expected, CASE WHEN value IS NULL THEN 'no value' WHEN expected IS NOT NULL THEN CASE WHEN {_near_sql('value', 'expected')} THEN 'proven' ELSE 'mismatch' END
WHEN {_near_sql('value', 'official')} THEN 'proven' WHEN id % 6 = 0 THEN 'disputed' ELSE 'mismatch' END AS verdict FROM c""")
def answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on order totals computed from lines, against what orders state."""
    calcs, k = _calcs(spark, sf_dir), F.col("id") % 3
    calcs = calcs.select("id", "value", _null("double").alias("tol"), F.when(k > 0, F.col("stated")).alias("expect"), _null("double").alias("num"), _null("double").alias("option_number"), F.when(k == 0, F.array("stated")).alias("official"), F.when(F.col("id") % 6 == 0, "misprint").alias("dispute"))
    return validate.answer_checks(calcs)


@query(f"""WITH {_LINES_OF}, c AS (SELECT o_orderkey AS id, coalesce(v, -1.0) AS v, o_totalprice AS e, o_orderkey % 8 AS k FROM orders LEFT JOIN t ON id = o_orderkey)
SELECT id, NULL::INTEGER AS row, 'no rows' AS rule, 'error' AS severity FROM c WHERE k = 0
UNION ALL SELECT id, 2, 'row is no label and value', 'error' FROM c WHERE k = 1 UNION ALL SELECT id, 1, 'answer names no row', 'error' FROM c WHERE k = 2 UNION ALL SELECT id, 1, 'row gives an error', 'error' FROM c WHERE k = 3
UNION ALL SELECT id, NULL, 'answers and expected values differ in number', 'error' FROM c WHERE k IN (2, 4) UNION ALL SELECT id, 1, 'row has no number', 'error' FROM c WHERE k = 3
UNION ALL SELECT id, CASE WHEN k = 1 THEN 2 ELSE 1 END, CASE WHEN {_near_sql('v', 'e', '0.02::DOUBLE')} THEN 'proven' ELSE 'differs from what is expected' END, CASE WHEN {_near_sql('v', 'e', '0.02::DOUBLE')} THEN 'proven' ELSE 'error' END FROM c WHERE k IN (1, 5)
UNION ALL SELECT id, 1, CASE WHEN {_near_sql('v', 'e')} THEN 'proven' WHEN id % 16 = 6 THEN 'disputed' ELSE 'not in the official solution' END, CASE WHEN {_near_sql('v', 'e')} THEN 'proven' WHEN id % 16 = 6 THEN 'warning' ELSE 'error' END FROM c WHERE k = 6
UNION ALL SELECT id, 2, 'nothing to check against', 'warning' FROM c WHERE k = 7""")
def working_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and verdicts of workings of two rows: the lines' total and its double."""
    k, v = F.col("id") % 8, F.coalesce("value", F.lit(-1.0))
    text = v.cast("decimal(20,2)").cast("string")
    some = lambda c, x: F.when(c, F.array(x))
    calcs = _calcs(spark, sf_dir).select(
        "id", F.when(k == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("total"), F.lit("twice"))).alias("labels"), F.when(k == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(2), F.when(k == 1, 3).otherwise(2))).alias("widths"),
        F.array(F.when(k == 3, "#DIV/0!").otherwise(text), F.when(k == 1, text).otherwise((v * 2).cast("decimal(20,2)").cast("string"))).alias("values"),
        F.when(k == 2, F.array(F.lit("nothing"))).when(k == 4, F.array(F.lit("total"), F.lit("2"))).when(k.isin(3, 5), F.array(F.lit("total"))).when(k == 6, F.array(F.lit("1"))).alias("answer"), F.when(k.isin(1, 5), F.lit(0.02)).alias("tol"),
        F.when(k.isin(1, 2, 4), F.array("stated")).alias("expect"), some(k == 5, F.col("stated")).alias("num"), F.when(k == 3, F.col("stated")).alias("option_number"), some(k == 6, F.col("stated")).alias("official"), F.when(F.col("id") % 16 == 6, "misprint").alias("dispute"))
    return validate.working_checks(calcs)


@query("""SELECT 'required' AS rule, doc_id::VARCHAR AS subject, 'title' AS detail FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT 'required', doc_id::VARCHAR, 'lang' FROM documents WHERE doc_id % 5 = 0""")
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that are null or empty."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("title"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")).otherwise("").alias("lang"))
    return validate.required(rows, ["title", "lang"], F.col("doc_id")).select("rule", "subject", "detail")


@query("""SELECT rule, subject, detail FROM (SELECT 'required' AS rule, doc_id::VARCHAR AS subject, 'title' AS detail FROM documents WHERE doc_id % 4 = 0) ORDER BY rule, subject, detail LIMIT 25""")
def gate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The errors that a gate names before it stops a write."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("title"))
    return validate.first_errors(validate.required(rows, ["title"], F.col("doc_id"))).select("rule", "subject", "detail")


# ---- sinks and readers


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN 'kept' ELSE 'new' END AS header FROM orders WHERE o_orderkey % 6 <> 3 UNION ALL SELECT o_orderkey, 'E', 'other' FROM orders WHERE o_orderkey % 6 = 3")
def written_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after a run that overwrites nothing: every third was there, every sixth of them from another file."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    there = orders.where("o_orderkey % 3 = 0").withColumn("header", F.when(F.col("o_orderkey") % 6 == 3, "other").otherwise("kept"))
    there = there.withColumn("o_orderstatus", F.when(F.col("header") == "other", "E").otherwise(F.col("o_orderstatus")))
    return sinks.write_once(orders.withColumn("header", F.lit("new")), there, "o_orderkey", "header")[0]


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'old' ELSE lang END AS lang FROM documents WHERE doc_id % 10 = 0 OR doc_id % 4 = 1")
def first_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untouched copies of documents with a page that isn't typed, written the first time only."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    pages = docs.select("doc_id", F.lit("typed").alias("mode")).unionByName(docs.where("doc_id % 4 = 1 or doc_id % 20 = 0").select("doc_id", F.lit("scanned").alias("mode")))
    return sinks.raw_copies(docs, docs.where("doc_id % 10 = 0").withColumn("lang", F.lit("old")), pages, "doc_id")


@query("SELECT p_partkey, length(p_name)::INTEGER + CASE WHEN p_size % 2 = 0 THEN 1000 ELSE 0 END AS value FROM part")
def memo_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by content hash: those of even sizes come from a cache, the others are computed."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_brand")
    compute = lambda d: d.withColumn("value", F.length("p_name"))
    cache = rows.where("p_size % 2 = 0").select(T.content_hash("p_name", "p_size").alias("hash"), (F.length("p_name") + 1000).alias("value"))
    return sinks.memo(rows, cache, ["p_name", "p_size"], compute).select("p_partkey", "value")


@query("SELECT doc_id, lang, source FROM documents")
def checked_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON by language behind a gate that finds nothing, and read again."""
    path = f"{scratch_dir(spark)}/json"
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    none = validate.required(docs.where("doc_id < 0"), ["lang"], F.col("doc_id"))
    sinks.write_checked(docs, none, path, ["lang"])
    return spark.read.schema("doc_id long, source string, lang string").json(path).select("doc_id", "lang", "source")


@query("SELECT doc_id, lang, row_number() OVER (ORDER BY source, doc_id)::INTEGER AS place FROM documents")
def json_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a folder of JSON files, each an object or a list of them, in the order of their paths."""
    path = f"{scratch_dir(spark)}/folder"
    lists = table(spark, sf_dir, "documents").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", "lang"))).alias("x"))
    lists.select("source", F.to_json("x").alias("j")).write.partitionBy("source").text(path)
    rows = markup.read_json_folder(spark, f"{path}/*", "doc_id long, lang string")
    return rows.select("doc_id", "lang", F.row_number().over(Window.orderBy("_file", "doc_id")).alias("place"))


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS no FROM documents),
m AS (SELECT doc_id, no, CASE WHEN no % 4 = 0 THEN 'The remaining questions: ' || s WHEN no % 7 = 0 THEN s || ' is not covered' ELSE s END AS s FROM l) SELECT doc_id, no FROM m WHERE regexp_matches(s, '{P.SOLUTION_NOTE}')""")
def solution_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of solution sheets that are notes."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "s")).withColumn("no", F.col("i") + 1)
    s = F.when(F.col("no") % 4 == 0, F.concat(F.lit("The remaining questions: "), "s")).when(F.col("no") % 7 == 0, F.concat("s", F.lit(" is not covered"))).otherwise(F.col("s"))
    return rows.where(s.rlike(P.SOLUTION_NOTE)).select("doc_id", "no")


@query("SELECT n_nationkey::VARCHAR AS a, n_name || ', \"the\" ' || n_regionkey AS b FROM nation")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as delimited text with commas and quotes in it, and read again."""
    path = f"{scratch_dir(spark)}/csv"
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string"), F.concat("n_name", F.lit(', "the" '), "n_regionkey"))
    nations.write.csv(path, escape='"')
    return markup.read_csv(spark, path).toDF("a", "b")


@query("SELECT conv_id, count(*) AS n_lines, sum(length(s))::BIGINT AS n_chars FROM (SELECT conv_id, unnest(string_split(string_agg(text, chr(10) ORDER BY turn), chr(10))) AS s FROM conversations GROUP BY conv_id) GROUP BY conv_id")
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as a text file each, and read whole."""
    path = f"{scratch_dir(spark)}/texts"
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    table(spark, sf_dir, "conversations").groupBy("conv_id").agg(said.alias("text")).write.partitionBy("conv_id").option("maxRecordsPerFile", 1).text(path)
    read = markup.read_texts(spark, f"{path}/*")
    lines = F.split(F.regexp_replace("text", "\n$", ""), "\n")
    total = F.aggregate(F.transform(lines, lambda x: F.length(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return read.select(F.regexp_extract("path", r"conv_id=(\d+)", 1).cast("long").alias("conv_id"), F.size(lines).cast("long").alias("n_lines"), total.alias("n_chars"))


@query("""SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'office' WHEN 3 THEN 'sheet' WHEN 4 THEN 'csv' ELSE 'text' END AS kind FROM pages""")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input files by the kind that their names say."""
    ends = F.array(*(F.lit(x) for x in (".PDF", ".jpeg", ".docx", ".xlsm", ".csv", ".txt", "")))
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("in.put/f"), "page_id", F.get(ends, (F.col("page_id") % 7).cast("int"))).alias("path"))
    return markup.route(rows).select("page_id", "kind")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS no FROM documents),
k AS (SELECT doc_id, no, (no - 1) // 10 + 1 AS page, s, no % 10 IN (3, 4, 8, 0) AS o, CASE no % 10 WHEN 5 THEN 'key' WHEN 6 THEN 'margin' WHEN 7 THEN 'blank' WHEN 1 THEN 'figure' WHEN 2 THEN 'table' ELSE 'line' END AS kind FROM l),
w AS (SELECT *, coalesce(lag(o) OVER p, false) AS was, row_number() OVER p = 1 AS first, lead(o) OVER p IS NULL AND o AS ends FROM k WINDOW p AS (PARTITION BY doc_id, page ORDER BY no)),
e AS (SELECT doc_id, no, list_concat(CASE WHEN first THEN ['=== page ' || page || ' ==='] ELSE [] END, CASE WHEN was AND NOT o THEN ['[[/options]]'] ELSE [] END, CASE WHEN o AND NOT was THEN ['[[options]]'] ELSE [] END,
CASE kind WHEN 'key' THEN ['[[key]] ' || s] WHEN 'margin' THEN ['[[item ' || no || ']]', '#~ ' || s] WHEN 'blank' THEN list_concat(['[[blank]]'], CASE WHEN s <> '' THEN ['#~ [entry] ' || s] ELSE [] END) WHEN 'figure' THEN ['[[figure f' || no || ']]']
WHEN 'table' THEN ['[[table t' || no || ']]', s || chr(9) || 'x', '[[/table]]'] ELSE [CASE WHEN no % 10 = 9 THEN '#~ ' ELSE '' END || s] END, CASE WHEN ends THEN ['[[/options]]'] ELSE [] END) AS a FROM w),
f AS (SELECT doc_id, no, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM e)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY no, i)::INTEGER AS place, line FROM f""")
def emitted_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of pages of ten lines each as marked-up sources."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).withColumn("place", F.col("i") + 1)
    k, no = F.col("place") % 10, F.col("place")
    kind = F.when(k == 5, "key").when(k == 6, "margin").when(k == 7, "blank").when(k == 1, "figure").when(k == 2, "table").otherwise("line")
    segments = rows.select(
        "doc_id", (F.floor((no - 1) / 10) + 1).alias("page"), "place", kind.alias("kind"), "text", k.isin(3, 4, 8, 0).alias("opt"), (k == 9).alias("ignored"), F.concat(F.when(k == 1, "f").otherwise("t"), no).alias("id"), _null("string").alias("src"),
        F.array(F.array("text", F.lit("x"))).alias("rows"), no.alias("num"))
    return markup.emit_source(segments)


# ---- items of marked-up papers

#: SQL of the paper fold: what each record does to the state, one record after another.
_FOLD = f"""ev AS (SELECT doc_id, no, page, trim(text, ' ') AS t, fig_id, table_id, CASE WHEN kind = 'directive' AND starts_with(text, '[[table') THEN 'table' WHEN kind = 'directive' AND text IN ('[[options]]', '[[/options]]') THEN 'options'
  WHEN kind = 'directive' AND text = '[[item]]' THEN 'item' WHEN kind = 'directive' AND text = '[[head]]' THEN 'head' WHEN kind = 'directive' AND text = '[[end]]' THEN 'end' WHEN kind = 'directive' AND text = '[[part]]' THEN 'part' WHEN kind IN ('figure', 'key') THEN kind WHEN kind = 'text' THEN CASE WHEN opt THEN 'opt' ELSE 'line' END END AS e FROM r),
en AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS k, CASE WHEN e IN ('line', 'opt') THEN nullif(regexp_extract(t, '{P.QUESTION_START.replace('(?=' + chr(92) + 'S)', '')}', 1), '')::INTEGER END AS q,
  regexp_matches(t, '{P.SECTION}') AND length(t) < 90 AS sec, regexp_matches(t, '{P.ROMAN_SUBPART}') AS rom, starts_with(t, '**') AND ends_with(t, '**') AND length(t) < 90 AS bold FROM ev WHERE e IS NOT NULL AND e NOT IN ('options', 'part')),
f AS (SELECT doc_id, 0::BIGINT AS k, 0 AS no, 0 AS open, 0 AS last, NULL::INTEGER AS due, '' AS told, 0 AS n, NULL::INTEGER AS num FROM documents
  UNION ALL SELECT doc_id, k, no, CASE WHEN e = 'end' THEN 0 WHEN e = 'key' AND open = 0 AND n > 0 THEN last WHEN isq THEN 2 WHEN ish OR ((e = 'table' OR e = 'figure') AND open = 0) THEN 1 ELSE open END,
    CASE WHEN isq THEN 2 WHEN ish OR ((e = 'table' OR e = 'figure') AND open = 0) THEN 1 ELSE last END, CASE WHEN isq THEN coalesce(q, 0) + 1 ELSE due END,
    CASE WHEN e = 'item' THEN 'item' WHEN e IN ('head', 'end') THEN 'head' WHEN lin THEN '' ELSE told END, CASE WHEN isq OR ish OR ((e = 'table' OR e = 'figure') AND open = 0) THEN n + 1 ELSE n END, CASE WHEN isq THEN q WHEN ish THEN NULL ELSE num END
  FROM (SELECT *, lin AND NOT isq AND (told = 'head' OR (sec AND NOT (rom AND open = 2)) OR (bold AND open <> 1) OR open = 0) AS ish FROM (SELECT *, lin AND (told = 'item' OR (q IS NOT NULL AND (due IS NULL OR q = due OR (q = 1 AND open = 1)))) AS isq
    FROM (SELECT en.*, f.open, f.last, f.due, f.told, f.n, f.num, en.e IN ('line', 'opt') AND NOT (en.e = 'opt' AND f.open <> 0 AND f.told = '') AS lin FROM f JOIN en ON en.doc_id = f.doc_id AND en.k = f.k + 1))))"""


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(I.segment(records(spark, sf_dir)), f"{scratch_dir(spark)}/items")


@query(f"""WITH RECURSIVE {LINES}, {_FOLD}, s AS (SELECT en.doc_id, f.n, f.last, f.num, f.open, en.* EXCLUDE (doc_id) FROM f JOIN en ON en.doc_id = f.doc_id AND en.k = f.k WHERE f.open > 0 AND e NOT IN ('item', 'head', 'end'))
SELECT doc_id, n::INTEGER AS n, CASE WHEN max(last) = 2 THEN 'q' ELSE 'head' END AS kind, CASE WHEN max(last) = 2 THEN max(num) END AS num, min(no)::INTEGER AS lo, count(*) FILTER (e = 'line')::INTEGER AS n_lines, coalesce(string_agg(t, chr(10) ORDER BY no) FILTER (e = 'key'), '') AS official,
coalesce(string_agg(table_id, ' ' ORDER BY no) FILTER (e = 'table'), '') AS tables, coalesce(string_agg(fig_id, ' ' ORDER BY no) FILTER (e = 'figure'), '') AS figures,
array_to_string(({tok_sql("coalesce(first(t ORDER BY no) FILTER (e = 'line'), '')")})[1:12], ' ') AS line_key FROM s GROUP BY doc_id, n""")
def item_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that marked-up papers hold: kind, number, place, lines, keys, tables and figures."""
    return _segmented(spark, sf_dir).select(
        "doc_id", "n", "kind", "num", "lo", F.size("lines").alias("n_lines"), "official", F.array_join("tables", " ").alias("tables"), F.array_join("figures", " ").alias("figures"), "line_key")


@query("""WITH RECURSIVE s AS (SELECT DISTINCT source AS id, regexp_extract(source, '\\d+')::INTEGER AS no FROM documents) SELECT 'exam_' || no || '_solutions' AS solution, 'exam_' || no AS paper FROM s WHERE no < 10""")
def source_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solutions with the paper of the most similar name."""
    no = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    names = table(spark, sf_dir, "documents").select(no.alias("pos")).distinct().where("pos < 10")
    files = names.select(F.concat(F.lit("exam_"), "pos").alias("id"), F.lit("paper").alias("role"), "pos").unionByName(names.select(F.concat(F.lit("exam_"), "pos", F.lit("_solutions")).alias("id"), F.lit("solution").alias("role"), "pos"))
    return I.pair_solutions(files).select("solution", "paper")


#: SQL of exam papers made from benchmark items: answer slots, explicit breaks, or lettered lines, by the item's number.
EXAMS = """exams AS (SELECT item_id AS doc_id, array_to_string(CASE item_id % 3
WHEN 0 THEN ['1. ' || a, '(a) ' || b, '[[blank]]', '(b) ' || a, '[[options]]', b, a, '[[/options]]', '[[key]] The correct answer is: ' || a, 'A case: ' || b, '(c) ' || a, '[[blank]]', '[[blank]]', 'note ' || b]
WHEN 1 THEN ['1. ' || b, '[[part]]', '(a) ' || a, '[[blank]]', '[[part head]]', 'passage ' || b, '[[part]]', b, '[[options]]', a, b, '[[/options]]', '[[key]] ' || b]
ELSE ['1. ' || a, 'and ' || b, 'A. ' || a, 'B) ' || b, 'wrapped ' || a, '(c) third'] END, chr(10)) AS text FROM (SELECT item_id, split_part(t, ' ', 1) || ' ' || item_id AS a, split_part(t, ' ', 2) || 'x' AS b FROM (SELECT item_id, replace(text, chr(10), ' ') AS t FROM benchmark)))"""


def exams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exam papers, as :data:`EXAMS` has them."""
    first = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")
    a, b = F.concat(F.get(first, 0), F.lit(" "), "item_id"), F.concat(F.get(first, 1), F.lit("x"))
    join = lambda *x: F.concat(*(F.lit(c) if isinstance(c, str) else c for c in x))
    slot, parts, letters = (F.array(*(F.lit(c) if isinstance(c, str) else c for c in lines)) for lines in (
        [join("1. ", a), join("(a) ", b), "[[blank]]", join("(b) ", a), "[[options]]", b, a, "[[/options]]", join("[[key]] The correct answer is: ", a), join("A case: ", b), join("(c) ", a), "[[blank]]", "[[blank]]", join("note ", b)],
        [join("1. ", b), "[[part]]", join("(a) ", a), "[[blank]]", "[[part head]]", join("passage ", b), "[[part]]", b, "[[options]]", a, b, "[[/options]]", join("[[key]] ", b)],
        [join("1. ", a), join("and ", b), join("A. ", a), join("B) ", b), join("wrapped ", a), "(c) third"]))
    k = F.col("item_id") % 3
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.array_join(F.when(k == 0, slot).when(k == 1, parts).otherwise(letters), "\n").alias("text"))


_SLOT = f"""x0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM exams),
x1 AS (SELECT *, coalesce(last_value(CASE t WHEN '[[options]]' THEN true WHEN '[[/options]]' THEN false END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS inside FROM x0),
x2 AS (SELECT doc_id, no, t, CASE WHEN t IN ('[[options]]', '[[/options]]') THEN NULL WHEN starts_with(t, '[[part') THEN 'break' WHEN t = '[[blank]]' THEN 'blank' WHEN starts_with(t, '[[key]]') THEN 'key' WHEN inside THEN 'options' ELSE 'line' END AS p FROM x1),
x3 AS (SELECT *, p IN ('options', 'blank') AS slot, p = 'line' AND regexp_matches(t, '{P.PART_LABEL}') AS lab, bool_or(p = 'break') OVER (PARTITION BY doc_id) AS breaks FROM x2 WHERE p IS NOT NULL),
x4 AS (SELECT *, slot AND NOT coalesce(lag(slot) OVER o, false) AS grp, min(no) FILTER (lab) OVER (PARTITION BY doc_id) AS l1, min(no) FILTER (slot) OVER (PARTITION BY doc_id) AS s1,
  last_value(CASE WHEN slot OR p = 'line' THEN slot END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS closed FROM x3 WINDOW o AS (PARTITION BY doc_id ORDER BY no)),
x5 AS (SELECT *, sum(grp::INTEGER) OVER (PARTITION BY doc_id) AS groups, CASE WHEN l1 < s1 THEN l1 ELSE 1 END AS cut FROM x4),
x6 AS (SELECT *, sum(CASE WHEN breaks THEN (p = 'break')::INTEGER ELSE (no = cut OR (no > cut AND p = 'line' AND coalesce(closed, false)))::INTEGER END) OVER (PARTITION BY doc_id ORDER BY no) AS k FROM x5 WHERE breaks OR groups >= 2),
x7 AS (SELECT *, CASE WHEN NOT breaks AND k > 1 AND k = max(k) OVER (PARTITION BY doc_id) AND NOT bool_or(slot) OVER (PARTITION BY doc_id, k) THEN k - 1 ELSE k END AS k2 FROM x6),
x8 AS (SELECT *, min(no) FILTER (lab) OVER (PARTITION BY doc_id, k2) AS l2 FROM x7), x9 AS (SELECT *, NOT breaks AND k2 > 1 AND coalesce(no < l2, false) AS between_ FROM x8),
y AS (SELECT *, CASE WHEN breaks THEN bool_or(t = '[[part head]]') OVER (PARTITION BY doc_id, k2) ELSE between_ AND bool_or(between_ AND p = 'line') OVER (PARTITION BY doc_id, k2) END AS passage FROM x9 WHERE k2 > 0),
z AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY k2, NOT (NOT breaks AND passage)) AS part FROM y)"""


@query(f"""WITH {EXAMS}, {_SLOT}, g AS (SELECT doc_id, part::INTEGER AS part, bool_or(passage) AS passage, string_agg(t, chr(10) ORDER BY no) FILTER (p = 'line') AS text, coalesce(list(t ORDER BY no) FILTER (p = 'options'), []) AS o, count(*) FILTER (p = 'blank')::INTEGER AS blanks,
coalesce(string_agg(regexp_replace(t, '^\\[\\[key\\]\\] ', ''), chr(10) ORDER BY no) FILTER (p = 'key'), '') AS official FROM z GROUP BY ALL)
SELECT doc_id, part, passage, text, CASE WHEN NOT passage THEN trim(regexp_extract(text, '{P.PART_LABEL}')) END AS label, array_to_string(o, ' | ') AS options, blanks, official,
CASE WHEN official <> '' AND len(list_filter(o, lambda x: lower(x) = lower(regexp_replace(official, '{P.KEY_TEXT}', '')))) = 1 THEN list_position(list_transform(o, lambda x: lower(x)), lower(regexp_replace(official, '{P.KEY_TEXT}', '')))::INTEGER - 1 END AS a FROM g""")
def item_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of items with several answer slots: labels, passages, options, boxes, printed keys and the answers that these name."""
    found = I.segment(markup.source_lines(exams(spark, sf_dir)))
    p = found.select("doc_id", F.explode("parts").alias("p"))
    return p.select("doc_id", F.col("p.part").cast("int").alias("part"), F.col("p.head").alias("passage"), F.col("p.text").alias("text"), F.col("p.label").alias("label"), F.array_join("p.o", " | ").alias("options"), F.col("p.blanks").alias("blanks"), F.col("p.official").alias("official"), F.col("p.a").alias("a"))


@query(f"""WITH RECURSIVE {EXAMS}, l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM exams WHERE NOT contains(text, '[[')),
b AS (SELECT doc_id, x, list_max(list_filter(range(1, len(x)), lambda i: regexp_matches(x[i + 1], '^\\(?[Aa]\\s*[.)]\\s*.+$'))) AS z FROM l),
s AS (SELECT doc_id, x, z, z AS i, []::VARCHAR[] AS o FROM b WHERE z IS NOT NULL UNION ALL SELECT doc_id, x, z, i + 1, CASE WHEN len(o) < 5 AND upper(regexp_extract(x[i + 1], '{P.OPTION}', 1)) = 'ABCDE'[len(o) + 1] THEN list_append(o, trim(regexp_extract(x[i + 1], '{P.OPTION}', 2))) ELSE list_append(o[1:len(o) - 1], o[len(o)] || ' ' || x[i + 1]) END FROM s WHERE i < len(x))
SELECT doc_id, array_to_string(x[1:z], chr(10)) AS stem, array_to_string(o, ' | ') AS options, 'MCQ 1' AS name, 'lower-case letters read as options' AS checks FROM s WHERE i = len(x)""")
def lettered_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose options are lettered lines at their end, wrapped ones joined."""
    found = I.segment(markup.source_lines(exams(spark, sf_dir))).where("size(o) > 0")
    return found.select("doc_id", "stem", F.array_join("o", " | ").alias("options"), "name", F.array_join("checks", " | ").alias("checks"))


def _sheets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Papers of a question for each turn of a conversation, and solution sheets for every second one, with a remark, a stray solution and a note."""
    turns = table(spark, sf_dir, "conversations").withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).withColumn("w", F.concat(F.get(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), 0), F.lit(" told")))
    line = F.concat(F.col("k"), F.lit(". "), "w")
    gathered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("k", line.alias("s"))))), lambda x: x["s"])
    both = turns.where("k < 90").groupBy("conv_id").agg(gathered(F.lit(True)).alias("all"), gathered(F.col("k") % 2 == 0).alias("even"))
    sheet = F.concat(F.array(F.lit("A remark")), F.transform("even", lambda x: F.concat(x, F.lit(" in the sheet"))), F.array(F.lit("99. stray"), F.lit("The remaining questions are straightforward")))
    text = lambda c: F.array_join(c, "\n").alias("text")
    papers = I.segment(markup.source_lines(both.select(F.col("conv_id").alias("doc_id"), text("all"))))
    root = scratch_dir(spark)
    sheets = I.segment(markup.source_lines(both.select(F.col("conv_id").alias("doc_id"), text(sheet))), solution=True).withColumn("paper", F.col("doc_id"))
    return materialise(papers, f"{root}/papers"), materialise(sheets, f"{root}/sheets")


_TURNS = "q AS (SELECT conv_id AS paper, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS k, split_part(replace(text, chr(10), ' '), ' ', 1) || ' told' AS w FROM conversations)"


@query(f"""WITH {_TURNS} SELECT paper, k AS num, CASE WHEN k % 2 = 0 THEN w || ' in the sheet' ELSE '' END AS official, CASE WHEN k % 2 = 0 THEN k // 2 + 1 END::INTEGER AS e_lo FROM q WHERE k < 90""")
def attached_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with the official solution of their number."""
    solved, _ = I.attach_solutions(*_sheets(spark, sf_dir))
    return solved.where("kind = 'q'").select(F.col("doc_id").alias("paper"), "num", "official", F.col("e_lo").cast("int").alias("e_lo"))


@query(f"""WITH {_TURNS} SELECT paper, count(*) AS items, 0::BIGINT AS heads, count(*) FILTER (k % 2 = 0) AS official, 0::BIGINT AS answered, '' AS unanswered, 0::BIGINT AS checks, 1::BIGINT AS notes, 2::BIGINT AS unmatched FROM q WHERE k < 90 GROUP BY paper""")
def scaffold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was found of each paper, and solution lines that belong to no item."""
    return I.scaffold_report(*I.attach_solutions(*_sheets(spark, sf_dir))).withColumn("unanswered", F.array_join("unanswered", " "))
