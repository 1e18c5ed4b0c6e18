"""Queries over marked-up papers: sources, items and fidelity rules; the papers are made from documents by rules that both engines compute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from attesta.functions import patterns as P, text as T
from attesta.operators import review
from attesta.plans import fidelity
from attesta.plans.registry import gram_sql, query, tok_sql
from attesta.session import materialise, release_shuffles, scratch_dir, table
from attesta.sources import markup

#: SQL of marked-up sources: a document's lines, each with a mark by its place in a dozen.
MADE = """made AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda s, i: CASE i % 12
WHEN 1 THEN CASE WHEN i = 1 THEN '#! source v1 id=d' || doc_id || ' lang=' || lang || chr(10) ELSE '' END || s
WHEN 2 THEN '[[item]]' || chr(10) || s
WHEN 3 THEN i // 12 + 1 || '. ' || s
WHEN 4 THEN '[[table t' || i || ']]' || chr(10) || replace(s, ' ', chr(9)) || chr(10) || 'a' || chr(9) || 'b' || chr(10) || '[[/table]]'
WHEN 5 THEN '[[options]]' || chr(10) || s || chr(10) || 'second ' || i || chr(10) || '[[/options]]'
WHEN 6 THEN '[[figure f' || i || ' view/f' || i || '.png]]'
WHEN 7 THEN '=== page ' || i // 12 + 2 || ' ===' || chr(10) || s
WHEN 8 THEN '[[key]] ' || s
WHEN 9 THEN '#~ ' || s
WHEN 10 THEN '**Section ' || i || '**'
WHEN 11 THEN '[[part]]' || chr(10) || s
ELSE '[[head]]' || chr(10) || s || chr(10) || '[[end]]' END), chr(10)) AS text FROM documents)"""

_RUN = "(PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND {end})"
#: SQL of the reader's records of those sources.
LINES = f"""{MADE},
p0 AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS no, regexp_replace(unnest(string_split(text, chr(10))), '\\s+$', '') AS t FROM made),
p1 AS (SELECT *, no = 1 AND starts_with(t, '#!') AS m, regexp_matches(t, '{P.PAGE}') AS pg, starts_with(t, '#~') AS ig, regexp_matches(t, '{P.TABLE_OPEN}') AS op, t = '{P.TABLE_CLOSE}' AS cl FROM p0),
p2 AS (SELECT *, coalesce(last_value(CASE WHEN pg THEN regexp_extract(t, '{P.PAGE}', 1)::INTEGER END IGNORE NULLS) OVER {_RUN.format(end='CURRENT ROW')}, 1) AS page,
  nullif(last_value(CASE WHEN op THEN regexp_extract(t, '{P.TABLE_OPEN}', 1) WHEN cl THEN '' END IGNORE NULLS) OVER {_RUN.format(end='1 PRECEDING')}, '') AS inside FROM p1),
p3 AS (SELECT *, CASE WHEN m THEN 'meta' WHEN pg THEN 'page' WHEN ig THEN 'ignored' WHEN op OR cl THEN 'directive' WHEN inside IS NOT NULL THEN 'table_row' WHEN regexp_matches(t, '{P.FIGURE}') THEN 'figure'
  WHEN regexp_matches(t, '{P.KEY_LINE}') THEN 'key' WHEN regexp_matches(t, '{P.DIRECTIVE}') THEN 'directive' WHEN trim(t, ' ') = '' THEN 'blank' ELSE 'text' END AS kind FROM p2),
r AS (SELECT doc_id, no, page, kind, CASE WHEN kind = 'key' THEN regexp_extract(t, '{P.KEY_LINE}', 1) ELSE t END AS text, CASE WHEN op THEN regexp_extract(t, '{P.TABLE_OPEN}', 1) WHEN cl OR kind = 'table_row' THEN inside END AS table_id,
  CASE WHEN kind = 'figure' THEN regexp_extract(t, '{P.FIGURE}', 1) END AS fig_id, CASE WHEN kind = 'figure' THEN nullif(regexp_extract(t, '{P.FIGURE}', 2), '') END AS fig_src,
  kind = 'text' AND coalesce(last_value(CASE WHEN kind = 'directive' THEN CASE WHEN t = '[[options]]' THEN true WHEN t = '[[/options]]' OR t = '[[item]]' OR starts_with(t, '[[part') THEN false END END IGNORE NULLS) OVER {_RUN.format(end='1 PRECEDING')}, false) AS opt FROM p3)"""
#: SQL of two stretches of each document.
SPANS = "spans AS (SELECT doc_id, item, lo, hi FROM documents, (VALUES ('one', 2, 7), ('two', 8, 30)) v(item, lo, hi))"


def made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked-up sources, as :data:`MADE` has them."""

    def mark(s: Column, i: Column) -> Column:
        no = i + 1
        k, text = no % 12, lambda x: x.cast("string")
        join = lambda *x: F.concat(*(F.lit(c) if isinstance(c, str) else c for c in x))
        twelfth = F.floor(no / 12)
        return (
            F.when(k == 1, F.concat(F.when(no == 1, join("#! source v1 id=d", F.col("doc_id"), " lang=", F.col("lang"), "\n")).otherwise(""), s))
            .when(k == 2, join("[[item]]\n", s)).when(k == 3, join(text(twelfth + 1), ". ", s))
            .when(k == 4, join("[[table t", text(no), "]]\n", F.replace(s, F.lit(" "), F.lit("\t")), "\na\tb\n[[/table]]"))
            .when(k == 5, join("[[options]]\n", s, "\nsecond ", text(no), "\n[[/options]]")).when(k == 6, join("[[figure f", text(no), " view/f", text(no), ".png]]"))
            .when(k == 7, join("=== page ", text(twelfth + 2), " ===\n", s)).when(k == 8, join("[[key]] ", s)).when(k == 9, join("#~ ", s)).when(k == 10, join("**Section ", text(no), "**"))
            .when(k == 11, join("[[part]]\n", s)).otherwise(join("[[head]]\n", s, "\n[[end]]")))

    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), mark), "\n").alias("text"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reader's records of those sources."""
    return markup.source_lines(made(spark, sf_dir))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stretches of each document, as :data:`SPANS` has them."""
    two = F.array(*(F.struct(F.lit(item).alias("item"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for item, lo, hi in (("one", 2, 7), ("two", 8, 30))))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(two).alias("s")).select("doc_id", "s.*")


@query(f"WITH {LINES} SELECT * FROM r")
def marked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of marked-up sources: page, kind, table, figure and option list of each line."""
    return records(spark, sf_dir).select("doc_id", "no", "text", "page", "kind", "table_id", F.col("fig.id").alias("fig_id"), F.col("fig.src").alias("fig_src"), "opt")


@query("SELECT doc_id, 'd' || doc_id AS id, lang FROM documents")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first line of each source says of it."""
    return made(spark, sf_dir).select("doc_id", markup.provenance("text").alias("m")).select("doc_id", F.col("m")["id"].alias("id"), F.col("m")["lang"].alias("lang"))


@query(f"WITH {LINES} SELECT doc_id, no, text FROM r WHERE kind IN ('text', 'table_row')")
def content_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose words belong to the document."""
    return markup.content(records(spark, sf_dir)).select("doc_id", "no", "text")


@query(f"WITH {LINES}, {SPANS} SELECT doc_id, item, no, text FROM r JOIN spans USING (doc_id) WHERE kind IN ('text', 'table_row') AND no BETWEEN lo AND hi")
def span_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content lines of each stretch."""
    return markup.line_span(records(spark, sf_dir), spans(spark, sf_dir)).select("doc_id", "item", "no", "text")


@query(f"""WITH {LINES}, {SPANS}, h AS (SELECT doc_id, item, list_sort(list(DISTINCT table_id) FILTER (kind = 'directive' AND starts_with(text, '[[table'))) AS t, list_sort(list(DISTINCT fig_id) FILTER (kind = 'figure')) AS f
FROM r JOIN spans USING (doc_id) WHERE no BETWEEN lo AND hi GROUP BY ALL)
SELECT doc_id, item, coalesce(array_to_string(t, ' '), '') AS tables, coalesce(array_to_string(f, ' '), '') AS figures FROM spans LEFT JOIN h USING (doc_id, item)""")
def span_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and figures of each stretch."""
    found = markup.objects_in_span(records(spark, sf_dir), spans(spark, sf_dir))
    return found.select("doc_id", "item", F.array_join("tables", " ").alias("tables"), F.array_join("figures", " ").alias("figures"))


@query(f"""WITH {LINES} SELECT doc_id AS source, array_to_string(flatten(list({tok_sql('text')} ORDER BY no)), ' ') AS words FROM r WHERE kind IN ('text', 'table_row', 'ignored', 'key') GROUP BY doc_id""")
def source_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens of each source in order, across its lines."""
    return fidelity.source_tokens(records(spark, sf_dir), exact=False).select("source", F.array_join("tokens", " ").alias("words"))


@query(f"""WITH {LINES}, k AS (SELECT doc_id, page, no, row_number() OVER (PARTITION BY doc_id, page ORDER BY no)::INTEGER AS k FROM r WHERE kind = 'text')
SELECT doc_id, page, k, no, (100 * page + 10 * k)::DOUBLE AS y0 FROM k WHERE page <= 3 AND k <= 6""")
def paged_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines with the boxes that a map of page and place gives."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page"))
    boxes = docs.select("doc_id", "page", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("k"))
    boxes = boxes.withColumn("y0", (100 * F.col("page") + 10 * F.col("k")).cast("double"))
    return markup.line_boxes(records(spark, sf_dir), boxes).select("doc_id", "page", "k", "no", "y0")


_BOXES = "b AS (SELECT doc_id, no, page, (no * 10)::DOUBLE AS y0, (no * 10 + 8)::DOUBLE AS y1, length(text)::DOUBLE AS x1 FROM r)"


@query(f"WITH {LINES}, {SPANS}, {_BOXES} SELECT doc_id, item, page, min(0.0::DOUBLE) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b JOIN spans USING (doc_id) WHERE no BETWEEN lo AND hi GROUP BY ALL")
def span_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around each stretch's lines on each of its pages."""
    no = F.col("no")
    boxes = records(spark, sf_dir).select("doc_id", "no", "page", F.lit(0.0).alias("x0"), (no * 10).cast("double").alias("y0"), F.length("text").cast("double").alias("x1"), (no * 10 + 8).cast("double").alias("y1"))
    return review.span_boxes(spans(spark, sf_dir), boxes, ["doc_id", "item"])


#: SQL of texts with numbered lines, and where an edited one differs: lines changed, one left out, one added.
EDITED = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) || ' #' || generate_subscripts(string_split(text, chr(10)), 1) AS s, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS no FROM documents),
e AS (SELECT doc_id, no, no % 5 = 2 AS changed FROM l)"""


def _edited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    numbered = F.transform(F.split("text", "\n"), lambda s, i: F.concat(s, F.lit(" #"), i + 1))
    edited = F.transform(numbered, lambda s, i: F.when(i % 5 == 1, F.concat(s, F.lit(" corrected"))).otherwise(s))
    return docs.select("doc_id", F.array_join(edited, "\n").alias("text")), docs.select("doc_id", F.array_join(numbered, "\n").alias("text"))


@query(f"WITH {EDITED} SELECT doc_id, no FROM e WHERE changed")
def changed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that differ from the untouched text."""
    return review.changed_lines(*_edited(spark, sf_dir))


@query(f"WITH {EDITED}, {SPANS} SELECT doc_id, item FROM spans s WHERE EXISTS (SELECT 1 FROM e WHERE e.doc_id = s.doc_id AND changed AND no BETWEEN lo AND hi)")
def touched_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches that hold a changed line."""
    return review.touched(spans(spark, sf_dir), review.changed_lines(*_edited(spark, sf_dir))).select("doc_id", "item")


# ---- items of papers

_W = "string_split(s, ' ')"
#: SQL of items made from each document's lines, some altered; the source is the document itself.
ITEMS = f"""l AS (SELECT doc_id, source AS src, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS n FROM documents),
i AS (SELECT doc_id AS paper, n, s, n % 9 = 0 AS head, n % 3 = 0 AS sub,
  CASE n % 5 WHEN 0 THEN s WHEN 1 THEN '<b>' || s || '</b>' WHEN 2 THEN array_to_string(({_W})[2:], ' ') WHEN 3 THEN s || ' 12 added words 345' ELSE replace(s, 'e', 'E') END AS q,
  CASE WHEN n % 3 = 1 THEN list_concat(({_W})[1:3], CASE WHEN n % 6 = 1 THEN ['nowhere to be found'] ELSE [] END) END AS o, CASE WHEN n % 7 <> 0 THEN n % 4 END AS a, n % 10 = 8 AS num,
  CASE WHEN n % 4 = 0 THEN list_concat([array_to_string(({_W})[1:2], ' ')], [array_to_string([({_W})[3], 'zzzq'], ' ')]) ELSE [] END AS shown, n % 4 = 0 AS media, n % 8 <> 7 AS placed,
  CASE WHEN n % 3 = 0 THEN CASE WHEN n % 6 = 0 THEN 'unseen official words 77' ELSE s END END AS official, CASE WHEN n % 5 = 1 THEN '' WHEN n % 5 = 2 THEN repeat('It follows from the text. ', 4) ELSE 'Because it is so.' END AS e,
  n % 6 = 2 AS parted, CASE WHEN n % 6 = 2 THEN CASE WHEN n % 12 = 2 THEN ({_W})[1] || ' nowhere' ELSE s END END AS key, n % 11 = 0 AS open FROM l)"""
_Q = f"regexp_replace(q, '{P.TAG}', ' ', 'g')"
_CHOICE = "(len(coalesce(o, [])) > 0 AND NOT sub AND NOT head)"
SEGMENTS = f"""sg AS (SELECT paper, n, unnest(list_concat([{_Q}], shown, CASE WHEN {_CHOICE} THEN o ELSE [] END, CASE WHEN parted THEN [s, ({_W})[1], 'a passage of its own'] ELSE [] END)) AS t FROM i)"""
#: SQL of a source's tokens, and of what they hold: words and triples.
KNOWN = f"""src AS (SELECT paper, flatten(list({tok_sql('s')} ORDER BY n)) AS st FROM l2 GROUP BY paper),
known AS (SELECT DISTINCT paper, 1 AS w, unnest(st) AS unit FROM src UNION SELECT DISTINCT paper, 3, unnest({gram_sql('st')}) FROM src)"""
_L2 = "l2 AS (SELECT doc_id AS paper, n, regexp_replace(s, '\\s+$', '') AS s FROM l WHERE trim(s, ' ') <> '')"


def units_sql(name: str, rows: str, keys: str, text: str) -> str:
    """SQL of hits and totals of texts' words or triples in the source: ``name`` with keys, hits, total."""
    return f"""{name}_t AS (SELECT {keys}, {tok_sql(text)} AS t FROM {rows}),
{name}_u AS (SELECT {keys}, 1 AS w, unnest(t) AS unit FROM {name}_t WHERE len(t) < 3 UNION ALL SELECT {keys}, 3, unnest({gram_sql('t')}) FROM {name}_t WHERE len(t) >= 3),
{name} AS (SELECT {keys}, count(k.unit) AS hits, count(*) AS total FROM {name}_u u LEFT JOIN known k USING (paper, w, unit) GROUP BY ALL)"""


#: Where a session has written the tables of :func:`paper_items`, by session and input.
_WRITTEN: dict[tuple[str, str], str] = {}


def paper_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(items, lines)``: items made from each document's lines, as :data:`ITEMS` has them, and the documents' records.

    Both are written once in a session, for all queries over them.
    """
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _WRITTEN:
        _WRITTEN[key] = _write_items(spark, sf_dir)
    return tuple(spark.read.parquet(f"{_WRITTEN[key]}/{name}") for name in ("items", "lines"))


def _write_items(spark: SparkSession, sf_dir: str) -> str:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("string").alias("paper"), F.posexplode(F.split("text", "\n")).alias("k", "s")).withColumn("n", F.col("k") + 1)
    n, s, w = F.col("n"), F.col("s"), F.split("s", " ")
    from_to = lambda a, b: F.array_compact(F.array(*(F.get(w, i) for i in range(a, b))))
    q = F.when(n % 5 == 0, s).when(n % 5 == 1, F.concat(F.lit("<b>"), s, F.lit("</b>"))).when(n % 5 == 2, F.array_join(F.slice(w, 2, F.size(w)), " ")).when(n % 5 == 3, F.concat(s, F.lit(" 12 added words 345"))).otherwise(F.replace(s, F.lit("e"), F.lit("E")))
    o = F.when(n % 3 == 1, F.concat(from_to(0, 3), F.when(n % 6 == 1, F.array(F.lit("nowhere to be found"))).otherwise(F.array().cast("array<string>"))))
    kind = StructType.fromDDL(fidelity.ITEM_SCHEMA)
    shown = F.struct(F.lit("table").alias("t"), *(F.lit(None).cast("string").alias(c) for c in ("title", "x", "caption")), from_to(0, 2).alias("head"), F.array(F.array_compact(F.array(F.get(w, 2), F.lit("zzzq")))).alias("rows"), F.concat(F.lit("t"), n).alias("src_id"))
    null = lambda t: F.lit(None).cast(t)
    strings = "array<string>"
    part = F.struct(
        F.lit("(a)").alias("label"), F.lit(False).alias("head"), s.alias("q"), F.array(F.get(w, 0)).alias("o"), null(strings).alias("choices"), F.lit(0).alias("a"), null("array<double>").alias("num"),
        F.when(n % 12 == 2, F.concat(F.get(w, 0), F.lit(" nowhere"))).otherwise(s).alias("official"), null("string").alias("e"), null(fidelity.MEDIA).alias("media"))
    passage = F.struct(*(F.lit(v).cast(t).alias(c) for c, v, t in (
        ("label", None, "string"), ("head", True, "boolean"), ("q", "a passage of its own", "string"), ("o", None, strings), ("choices", None, strings), ("a", None, "int"), ("num", None, "array<double>"), ("official", None, "string"), ("e", None, "string"), ("media", None, fidelity.MEDIA))))
    placed = lambda c: F.when(n % 8 != 7, c)
    values = {
        "paper": F.col("paper"), "source": F.col("paper"), "n": n, "name": F.concat(F.lit("Question "), n), "head": n % 9 == 0, "sub": n % 3 == 0, "q": q, "o": o, "a": F.when(n % 7 != 0, n % 4), "num": F.when(n % 10 == 8, F.array(F.lit(1.0))),
        "media": F.when(n % 4 == 0, F.array(shown)), "parts": F.when(n % 6 == 2, F.array(part, passage)), "lo": placed(n), "hi": placed(n), "official": F.when(n % 6 == 0, "unseen official words 77").when(n % 3 == 0, s),
        "e_lo": F.when(n % 3 == 0, n), "e_hi": F.when(n % 3 == 0, n), "e": F.when(n % 5 == 1, "").when(n % 5 == 2, F.repeat(F.lit("It follows from the text. "), 4)).otherwise("Because it is so."), "checks": F.when(n % 11 == 0, F.array(F.lit("confirm the cuts")))}
    made_items = rows.select(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields))
    lines = markup.source_lines(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    root = scratch_dir(spark)
    for rows, name in ((made_items, "items"), (lines, "lines")):
        rows.write.option("compression", "zstd").parquet(f"{root}/{name}")
    release_shuffles(spark)
    return root


def findings(spark: SparkSession, sf_dir: str, *rules: str) -> DataFrame:
    """Findings of some rules."""
    found, _, _ = fidelity.check_papers(*paper_items(spark, sf_dir), exact=False)
    return found.where(F.col("rule").isin(*rules)).select("rule", F.col("paper").cast("long").alias("paper"), "n", "detail")


_BASE = f"{ITEMS}, {_L2}, {KNOWN}"


@query(f"""WITH {_BASE}, {SEGMENTS}, {units_sql('sc', 'sg', 'paper, n', 't')} SELECT paper, n, coalesce(hits / total, 1.0) AS precision FROM i LEFT JOIN sc USING (paper, n)""")
def paper_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each item's texts stands in its source."""
    return fidelity.check_papers(*paper_items(spark, sf_dir), exact=False)[1].select(F.col("paper").cast("long").alias("paper"), "n", "precision")


@query(f"""WITH {_BASE}, {SEGMENTS}, {units_sql('sc', 'sg', 'paper, n', 't')}, lim AS (SELECT paper, CASE WHEN paper % 4 = 0 THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS least FROM src)
SELECT paper, n, coalesce(hits / total, 1.0) AS precision FROM i JOIN lim USING (paper) LEFT JOIN sc USING (paper, n) WHERE coalesce(hits / total, 1.0) < least""")
def low_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items below the threshold, which every fourth paper sets for itself."""
    items, lines = paper_items(spark, sf_dir)
    least = items.select("paper").distinct().where(F.col("paper").cast("long") % 4 == 0).withColumn("verbatim_min", F.lit(0.5))
    found, _, _ = fidelity.check_papers(items, lines, least=least, exact=False)
    return found.where("rule = 'precision'").select(F.col("paper").cast("long").alias("paper"), "n", F.col("detail").cast("double").alias("precision"))


@query(f"""WITH {_BASE}, op AS (SELECT paper, n, '' AS place, unnest(o) AS t, generate_subscripts(o, 1) AS k FROM i WHERE {_CHOICE} UNION ALL SELECT paper, n, '(a)', ({_W})[1], 1 FROM i WHERE parted),
{units_sql('sc', 'op', 'paper, n, place, k', 't')} SELECT 'option' AS rule, paper, n, concat_ws(' ', nullif(place, ''), 'option', k) AS detail FROM sc WHERE hits / total < 0.9""")
def paper_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options that aren't in the source as printed."""
    return findings(spark, sf_dir, "option")


@query(f"""WITH {_BASE}, c AS (SELECT paper, n, unnest({tok_sql("array_to_string(shown, ' ')")}) AS detail FROM i WHERE media) SELECT 'table cell' AS rule, paper, n, detail FROM c ANTI JOIN known k ON k.paper = c.paper AND k.w = 1 AND k.unit = c.detail""")
def paper_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of table cells that the source lacks."""
    return findings(spark, sf_dir, "table cell")


_INLINE, _LABEL = P.INLINE_LABEL, P.OPTION_LABEL
_BARE = f"CASE WHEN {_CHOICE} OR parted THEN CASE WHEN len(regexp_extract_all(s, '{_INLINE}')) >= 3 THEN regexp_replace(s, '{_INLINE}', ' ', 'g') ELSE regexp_replace(s, '{_LABEL}', '') END ELSE s END"
PAIRS = f"""own AS (SELECT paper, n, {tok_sql("array_to_string(list(t), ' ')")} AS own FROM (SELECT paper, n, unnest(list_concat([{_Q}], shown, CASE WHEN {_CHOICE} THEN o ELSE [] END, CASE WHEN parted THEN [s, ({_W})[1], 'a passage of its own'] ELSE [] END)) AS t,
  generate_subscripts(list_concat([{_Q}], shown, CASE WHEN {_CHOICE} THEN o ELSE [] END, CASE WHEN parted THEN [s, ({_W})[1], 'a passage of its own'] ELSE [] END), 1) AS g FROM i) GROUP BY paper, n),
pr AS (SELECT paper, n, {tok_sql(_BARE)} AS s2, own FROM i JOIN own USING (paper, n) WHERE placed AND trim(s, ' ') <> '')"""
PAIRS = PAIRS.replace("list(t)", "list(t ORDER BY g)")
RUNS = """tiny AS (SELECT paper, n, array_to_string(s2, ' ') AS context FROM {pairs} WHERE len(s2) BETWEEN 1 AND 2 AND len(list_filter(s2, lambda x: NOT list_contains(own, x))) > 0),
base AS (SELECT paper, n, s2 AS s, list_transform({gs}, lambda g: list_contains({go}, g)) AS f FROM {pairs} WHERE len(s2) >= 3),
pos AS (SELECT *, generate_subscripts(s, 1) AS p FROM base),
cov AS (SELECT *, (coalesce(f[p], false) OR (p > 1 AND coalesce(f[p - 1], false)) OR (p > 2 AND coalesce(f[p - 2], false))) AS c FROM pos),
isl AS (SELECT *, p - row_number() OVER (PARTITION BY paper, n ORDER BY p) AS g FROM cov WHERE NOT c),
run AS (SELECT paper, n, any_value(s) AS s, min(p) AS a, count(*) AS length FROM isl GROUP BY paper, n, g),
runs AS (SELECT paper, n, concat_ws(' ', nullif(array_to_string(s[greatest(1, a - {side}):a - 1], ' '), ''), '[' || array_to_string(s[a:a + length - 1], ' ') || ']', nullif(array_to_string(s[a + length:a + length + {side} - 1], ' '), '')) AS detail FROM run WHERE length >= {least}
  UNION ALL SELECT * FROM tiny WHERE {least} = 1)"""


def runs_sql(pairs: str, side: int, least: int) -> str:
    """SQL of the uncovered runs of ``s2`` by ``own``."""
    return RUNS.format(pairs=pairs, gs=gram_sql("s2"), go=gram_sql("own"), side=side, least=least)


@query(f"WITH {_BASE}, {PAIRS}, {runs_sql('pr', 3, 1)} SELECT 'missing from the item' AS rule, paper, n, detail FROM runs")
def paper_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of the source that an item lacks."""
    return findings(spark, sf_dir, "missing from the item")


def numbers_sql(pairs: str) -> str:
    """SQL of numbers that ``s2`` and ``own`` have unequally often."""
    of = lambda c, l, r: f"SELECT paper, n, unnest(list_filter({c}, lambda x: regexp_matches(x, '^\\d'))) AS value, {l} AS l, {r} AS r FROM {pairs}"  # noqa: E731, E741
    return f"""nd AS (SELECT paper, n, value, sum(l) AS l, sum(r) AS r FROM ({of('s2', 1, 0)} UNION ALL {of('own', 0, 1)}) GROUP BY ALL),
diff AS (SELECT paper, n, CASE WHEN l > r THEN 'missing ' || value ELSE 'not in source ' || value END AS detail FROM nd WHERE l <> r)"""


@query(f"WITH {_BASE}, {PAIRS}, {numbers_sql('pr')} SELECT 'numbers differ' AS rule, paper, n, detail FROM diff")
def paper_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that an item and its place in the source have unequally often."""
    return findings(spark, sf_dir, "numbers differ")


@query(f"WITH {_BASE}, {units_sql('sc', '(SELECT paper, n, key FROM i WHERE parted)', 'paper, n', 'key')} SELECT 'printed key' AS rule, paper, n, '1' AS detail FROM sc WHERE hits / total < 0.9")
def paper_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed keys of parts that aren't in the source as given."""
    return findings(spark, sf_dir, "printed key")


_OFFICIAL = f"""of AS (SELECT paper, n, s, official FROM i WHERE official IS NOT NULL AND official <> ''),
fs AS (SELECT paper, n, {tok_sql('s')} AS t, {tok_sql('official')} AS own FROM of WHERE NOT regexp_matches(s, '{P.SOLUTION_NOTE}') AND trim(s, ' ') <> ''),
pr AS (SELECT paper, n, CASE WHEN regexp_matches(coalesce(t[1], ''), '^\\d') THEN t[2:] ELSE t END AS s2, own FROM fs)"""


@query(f"""WITH {_BASE}, {_OFFICIAL}, {units_sql('sc', 'of', 'paper, n', 'official')}, {runs_sql('pr', 3, 1)}, {numbers_sql('pr')}
SELECT 'official precision' AS rule, paper, n, NULL AS detail FROM sc WHERE hits / total < 0.9 UNION ALL SELECT 'missing from the official solution', paper, n, detail FROM runs UNION ALL SELECT 'official numbers differ', paper, n, detail FROM diff""")
def paper_official(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official solutions against the source they come from."""
    found = findings(spark, sf_dir, "official precision", "missing from the official solution", "official numbers differ", "no solution source")
    return found.withColumn("detail", F.when(F.col("rule") != "official precision", F.col("detail")))


@query(f"""WITH {_BASE}, {PAIRS}, ct AS (SELECT paper, n, 0 AS k, own AS t FROM own UNION ALL SELECT paper, n, 1, {tok_sql("coalesce(official, '')")} FROM i),
wl AS (SELECT paper, n, s, coalesce(placed AND {_CHOICE}, false) AS mcq FROM i WHERE trim(s, ' ') <> '' AND NOT regexp_matches(s, '{P.SOLUTION_NOTE}')),
wt AS (SELECT paper, n, {tok_sql(f"CASE WHEN mcq THEN CASE WHEN len(regexp_extract_all(s, '{_INLINE}')) >= 3 THEN regexp_replace(s, '{_INLINE}', ' ', 'g') ELSE regexp_replace(s, '{_LABEL}', '') END ELSE s END")} AS t FROM wl),
ci AS (SELECT paper, flatten(list(t ORDER BY n, k)) AS own FROM ct GROUP BY paper), cs AS (SELECT paper, flatten(list(t ORDER BY n)) AS s2 FROM wt GROUP BY paper),
whole AS (SELECT paper, NULL::INTEGER AS n, s2, own FROM cs JOIN ci USING (paper)), have AS (SELECT DISTINCT paper, unnest({gram_sql('own')}) AS gram FROM whole),
pos AS (SELECT paper, s2 AS s, generate_subscripts(s2, 1) AS p FROM whole), gr AS (SELECT paper, unnest({gram_sql('s2')}) AS gram, generate_subscripts({gram_sql('s2')}, 1) AS p FROM whole), hit AS (SELECT DISTINCT paper, p FROM gr JOIN have USING (paper, gram)),
cv AS (SELECT DISTINCT paper, p + d AS p FROM hit, (VALUES (0), (1), (2)) v(d)), isl AS (SELECT *, p - row_number() OVER (PARTITION BY paper ORDER BY p) AS g FROM pos ANTI JOIN cv USING (paper, p)),
run AS (SELECT paper, any_value(s) AS s, min(p) AS a, count(*) AS length FROM isl GROUP BY paper, g)
SELECT 'in no item' AS rule, paper, NULL::INTEGER AS n, concat_ws(' ', nullif(array_to_string(s[greatest(1, a - 2):a - 1], ' '), ''), '[' || array_to_string(s[a:a + length - 1], ' ') || ']', nullif(array_to_string(s[a + length:a + length + 1], ' '), '')) AS detail FROM run WHERE length >= 3""")
def paper_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each source that none of its items holds."""
    return findings(spark, sf_dir, "in no item")


@query(f"WITH {ITEMS} SELECT 'unconfirmed' AS rule, paper, n, 'confirm the cuts' AS detail FROM i WHERE open")
def paper_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guesses that nobody has confirmed."""
    return findings(spark, sf_dir, "unconfirmed")


@query(f"""WITH {ITEMS}, p AS (SELECT paper, n, coalesce(o, []) AS o, a, num, e, sub FROM i WHERE NOT head AND NOT parted UNION ALL SELECT paper, n, [({_W})[1]], 0, false, e, false FROM i WHERE parted),
f AS (SELECT paper, n, unnest([CASE WHEN e = '' THEN 'explanation missing' END, CASE WHEN e <> '' AND length(e) < 60 THEN 'explanation short' END, CASE WHEN NOT (sub OR num) AND len(o) < 2 THEN 'fewer than two options' END,
  CASE WHEN len(list_distinct(o)) < len(o) THEN 'options repeat' END, CASE WHEN NOT (sub OR num) AND len(o) >= 2 AND a IS NULL THEN 'answer not set' END, CASE WHEN NOT (sub OR num) AND len(o) >= 2 AND NOT a BETWEEN 0 AND len(o) - 1 THEN 'answer out of range' END]) AS rule FROM p)
SELECT rule, paper, n, NULL::VARCHAR AS detail FROM f WHERE rule IS NOT NULL""")
def paper_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that are not set or point nowhere, options that repeat, explanations that are missing or short."""
    return findings(spark, sf_dir, "explanation missing", "explanation short", "fewer than two options", "options repeat", "answer not set", "answer out of range")


@query(f"""WITH {ITEMS}, p AS (SELECT * FROM i WHERE NOT head) SELECT paper, count(*) AS items, sum(parted::INTEGER) AS parts, sum(({_CHOICE})::INTEGER + parted::INTEGER) AS mcq, sum(num::INTEGER) AS numeric,
count(*) + sum(parted::INTEGER) - sum(parted::INTEGER) - sum(({_CHOICE})::INTEGER + parted::INTEGER) - sum(num::INTEGER) AS written FROM p GROUP BY paper""")
def paper_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, parts and kinds of answers of each paper."""
    return fidelity.paper_counts(paper_items(spark, sf_dir)[0]).withColumn("paper", F.col("paper").cast("long"))


@query(f"""WITH {LINES}, {SPANS}, x AS (SELECT doc_id AS paper, CASE item WHEN 'one' THEN 1 ELSE 2 END AS n, table_id, fig_id, kind, text, no FROM r JOIN spans USING (doc_id) WHERE no BETWEEN lo AND hi),
t AS (SELECT DISTINCT paper, n, table_id FROM x WHERE kind = 'directive' AND starts_with(text, '[[table')), f AS (SELECT DISTINCT paper, n, fig_id FROM x WHERE kind = 'figure'),
g AS (SELECT paper, n, count(*) FILTER (fig_id = 'f18' AND paper % 5 = 0 AND n = 2) AS met, list_sort(list(fig_id) FILTER (NOT (fig_id = 'f18' AND paper % 5 = 0 AND n = 2))) AS lost FROM f GROUP BY ALL)
SELECT 'table not shown' AS rule, paper, n, table_id AS detail FROM t WHERE NOT (n = 1 AND paper % 2 = 0 AND table_id = 't4') AND NOT (n = 2 AND paper % 7 = 0 AND table_id = 't16')
UNION ALL SELECT 'figure not shown', paper, n, array_to_string(lost, ' ') FROM g WHERE len(lost) > (CASE WHEN n = 2 THEN (paper % 3 = 0)::INTEGER + (paper % 5 = 0)::INTEGER ELSE 0 END) - met""")
def paper_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and figures of stretches of marked-up papers that their items don't show; drawn blocks count for figures."""
    kind = StructType.fromDDL(fidelity.ITEM_SCHEMA)
    block = lambda t, src: F.struct(F.lit(t).alias("t"), *(F.lit(None).cast("string").alias(c) for c in ("title", "x", "caption")), F.lit(None).cast("array<string>").alias("head"), F.lit(None).cast("array<array<string>>").alias("rows"), F.lit(src).cast("string").alias("src_id"))
    paper, one = F.col("doc_id"), F.col("item") == "one"
    shown = F.array_compact(F.array(
        F.when(one & (paper % 2 == 0), block("table", "t4")), F.when(~one & (paper % 3 == 0), block("flow", None)), F.when(~one & (paper % 5 == 0), block("fig", "f18"))))
    values = {"paper": paper.cast("string"), "source": paper.cast("string"), "n": F.when(one, 1).otherwise(2), "q": F.lit(""), "lo": F.col("lo"), "hi": F.col("hi"), "media": shown, "emedia": F.when(~one & (paper % 7 == 0), F.array(block("table", "t16")))}
    items = spans(spark, sf_dir).select(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields))
    lines = materialise(records(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("string")), f"{scratch_dir(spark)}/lines")
    found, _, _ = fidelity.check_papers(items, lines, exact=False)
    return found.where(F.col("rule").isin("table not shown", "figure not shown")).select("rule", F.col("paper").cast("long").alias("paper"), "n", "detail")


_REASONS = f"""{units_sql('sc', 'sg', 'paper, n', 't')}, pc AS (SELECT paper, n, coalesce(hits / total, 1.0) AS p FROM i LEFT JOIN sc USING (paper, n)),
why AS (SELECT paper, n, 'hand-made item (no source span)' AS reason FROM i WHERE NOT placed AND NOT head UNION ALL SELECT paper, n, 'MCQ' FROM i WHERE o IS NOT NULL AND NOT sub UNION ALL SELECT paper, n, '2 sub-parts' FROM i WHERE parted
  UNION ALL SELECT paper, n, 'text match' FROM pc WHERE p >= 0.9 AND p < 0.995)"""


@query(f"WITH {_BASE}, {SEGMENTS}, {_REASONS} SELECT * FROM why")
def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why to look at items though nothing is wrong with them."""
    return fidelity.check_papers(*paper_items(spark, sf_dir), exact=False)[2].withColumn("paper", F.col("paper").cast("long"))


@query(f"""WITH {_BASE}, {SEGMENTS}, {_REASONS}, {PAIRS}, {numbers_sql('pr')}, er AS (SELECT paper, n, count(*) AS errors FROM (SELECT paper, n FROM diff UNION ALL SELECT paper, n FROM i WHERE open) GROUP BY ALL),
so AS (SELECT paper, n, sum(CASE reason WHEN 'MCQ' THEN 0.5 WHEN '2 sub-parts' THEN 0.0 ELSE 3.0 END)::DOUBLE AS soft FROM why GROUP BY ALL),
al AS (SELECT coalesce(so.paper, er.paper) AS paper, coalesce(so.n, er.n) AS n, coalesce(errors, 0) AS errors, coalesce(errors, 0) * 10.0::DOUBLE + coalesce(soft, 0.0::DOUBLE) AS score FROM so FULL JOIN er ON so.paper = er.paper AND so.n = er.n)
SELECT * FROM al ORDER BY score DESC, paper::VARCHAR, n LIMIT 8""")
def review_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight items to compare with their print first."""
    return fidelity.review_first(*paper_items(spark, sf_dir), exact=False).withColumn("paper", F.col("paper").cast("long"))


@query(f"""WITH {_BASE}, of AS (SELECT paper, n, official FROM i WHERE official IS NOT NULL AND official <> ''), oft AS (SELECT paper, n, {tok_sql('official')} AS t FROM of),
u AS (SELECT paper, n, 1 AS w, unnest(t) AS unit FROM oft WHERE len(t) < 3 UNION ALL SELECT paper, n, 3, unnest({gram_sql('t')}) FROM oft WHERE len(t) >= 3),
sc AS (SELECT u.paper, n, count(k.unit) AS hits, count(*) AS total FROM u LEFT JOIN known k ON k.paper = u.paper + 1 AND k.w = u.w AND k.unit = u.unit WHERE u.paper + 1 IN (SELECT paper FROM src) GROUP BY ALL)
SELECT 'official precision' AS rule, paper, n FROM sc WHERE hits / total < 0.9 UNION ALL SELECT 'no solution source', paper, n FROM of WHERE paper + 1 NOT IN (SELECT paper FROM src)""")
def first_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official solutions whose sheet isn't there, against the first sheet of their paper: the next document."""
    items, lines = paper_items(spark, sf_dir)
    items = items.withColumn("e_source", F.when(F.col("official").isNotNull(), F.lit("nowhere")))
    sheets = items.select("paper").distinct().select("paper", (F.col("paper").cast("long") + 1).cast("string").alias("source"), F.lit(1).alias("place"))
    found, _, _ = fidelity.check_papers(items, lines, solutions=sheets, exact=False)
    return found.where(F.col("rule").isin("official precision", "no solution source")).select("rule", F.col("paper").cast("long").alias("paper"), "n")
