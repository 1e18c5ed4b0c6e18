"""Queries over printed pages: documents' words stand on pages by rules that both engines compute."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from attesta.functions import patterns as P
from attesta.operators import forms, layout, repeated, review
from attesta.plans.registry import query
from attesta.session import table

#: SQL of documents' words, each at a place: 40 points wide, 20 points a line.
WORDS = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS no FROM documents),
a AS (SELECT doc_id, no, list_filter(string_split(s, ' '), lambda x: x <> '') AS a FROM l),
w AS (SELECT doc_id, no, k::INTEGER AS k, text, (10 + 40 * k)::DOUBLE AS x0, (10 + 40 * k + least(36, 5 * length(text)))::DOUBLE AS x1, (20 * no)::DOUBLE AS y0, (20 * no + 10)::DOUBLE AS y1,
(40 + (7 * length(text) + 13 * k + no) % 60)::DOUBLE AS conf FROM (SELECT doc_id, no, unnest(a) AS text, generate_subscripts(a, 1) - 1 AS k FROM a))"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines, ``(doc_id, no, s)``."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "s")).select("doc_id", (F.col("i") + 1).alias("no"), "s")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' words at their places, as :data:`WORDS` has them."""
    rows = lines(spark, sf_dir).select("doc_id", "no", F.posexplode(F.filter(F.split("s", " "), lambda x: x != "")).alias("k", "text"))
    x0, n, y0 = 10 + 40 * F.col("k"), F.length("text"), 20 * F.col("no")
    number = lambda c, name: c.cast("double").alias(name)
    return rows.select("doc_id", "no", "k", "text", number(x0, "x0"), number(x0 + F.least(F.lit(36), 5 * n), "x1"), number(y0, "y0"), number(y0 + 10, "y1"), number(40 + (7 * n + 13 * F.col("k") + F.col("no")) % 60, "conf"))


@query(f"""WITH {WORDS} SELECT doc_id, no AS line, min(x0) AS x0, max(x1) AS x1, string_agg(text, ' ' ORDER BY x0) AS text, count(*) FILTER (conf < 80) AS low,
coalesce(array_to_string(list_sort(list(text) FILTER (conf < 80 OR regexp_matches(text, '\\d'))), ' '), '') AS flagged FROM w GROUP BY ALL""")
def ocr_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised words as lines with their doubtful words."""
    rows = words(spark, sf_dir).withColumn("block", F.lit(1)).withColumn("par", F.lit(1)).withColumnRenamed("no", "line")
    return layout.ocr_lines(rows, ["doc_id"]).select("doc_id", "line", "x0", "x1", "text", "low", F.array_join("flagged", " ").alias("flagged"))


@query(f"""WITH {WORDS} SELECT doc_id, avg(conf) AS mean, count(*) FILTER (conf < 80) AS low, count(*) FILTER (regexp_matches(text, '\\d')) AS numbers, count(*) AS words,
CASE WHEN avg(conf) < 72 OR count(*) FILTER (conf < 80) > count(*) * 0.3::DOUBLE THEN 'handwriting' ELSE 'scanned' END AS mode FROM w GROUP BY ALL""")
def ocr_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of each page and whether it looks handwritten."""
    return layout.ocr_pages(words(spark, sf_dir), ["doc_id"])


@query(f"WITH {WORDS} SELECT doc_id, no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM w GROUP BY ALL")
def line_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around each line's words."""
    return layout.union_boxes(words(spark, sf_dir), ["doc_id", "no"])


@query(f"""WITH {WORDS} SELECT doc_id, no, count(*) AS n FROM w WHERE NOT (no = 2 AND x1 <= 201.5) AND NOT (no BETWEEN 4 AND 5 AND x0 >= 28.5 AND x1 <= 151.5) GROUP BY ALL""")
def words_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each line that lie in none of a page's two boxes."""
    rows = words(spark, sf_dir)
    pages = rows.select("doc_id").distinct()
    box = lambda *sides: pages.select("doc_id", *(F.lit(float(v)).alias(c) for c, v in zip(forms.BOX, sides, strict=True)))
    boxes = box(0, 39, 200, 51).unionByName(box(30, 79, 150, 111))
    return layout.outside(rows, boxes, ["doc_id"]).groupBy("doc_id", "no").agg(F.count("*").alias("n"))


_SPREAD = "CASE WHEN doc_id % 3 = 0 AND k % 7 = 0 THEN 290 WHEN k % 2 = 0 THEN 20 + (k * 37) % 200 ELSE 380 + (k * 37) % 150 END"


@query(f"""WITH {WORDS}, p AS (SELECT doc_id, {_SPREAD} AS a, {_SPREAD} + 30 AS b FROM w),
f AS (SELECT doc_id, count(DISTINCT x) AS filled FROM (SELECT doc_id, unnest(range(greatest(a, 228), least(b, 372))) AS x FROM p) GROUP BY ALL),
s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (b < 300) AS l, count(*) FILTER (a > 300) AS r FROM p GROUP BY ALL)
SELECT doc_id, n >= 40 AND 144 - coalesce(filled, 0) >= 6 AND l > 15 AND r > 15 AS two_columns FROM s LEFT JOIN f USING (doc_id)""")
def column_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a clear gutter near the middle."""
    rows = words(spark, sf_dir)
    k, spread = F.col("k"), F.lit(37)
    x0 = F.when((F.col("doc_id") % 3 == 0) & (k % 7 == 0), 290).when(k % 2 == 0, 20 + (k * spread) % 200).otherwise(380 + (k * spread) % 150).cast("double")
    return layout.two_columns(rows.withColumn("x0", x0).withColumn("x1", F.col("x0") + 30).withColumn("page_width", F.lit(600)), ["doc_id"])


@query(f"""WITH {WORDS}, p AS (SELECT doc_id, no, text, x0 + 60 * (k // 3) AS x0, x1 + 60 * (k // 3) AS x1 FROM w),
g AS (SELECT *, lead(x0) OVER (PARTITION BY doc_id, no ORDER BY x0, x1) - x1 AS gap FROM p),
s AS (SELECT doc_id, no, count(*) AS n, list(gap) FILTER (gap IS NOT NULL) AS gaps, greatest(1.0, median(x1 - x0) / greatest(1.0, median(length(text)))) AS space FROM g GROUP BY ALL)
SELECT doc_id, no, n >= 3 AND coalesce(len(list_filter(gaps, lambda x: x > space * 2.6::DOUBLE * 1.6::DOUBLE)), 0) >= 2 AS gappy FROM s""")
def gappy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with wide gaps between words."""
    push = 60 * F.floor(F.col("k") / 3)
    rows = words(spark, sf_dir).withColumn("x0", F.col("x0") + push).withColumn("x1", F.col("x1") + push)
    return layout.gappy_lines(rows, ["doc_id", "no"])


@query(f"""WITH {WORDS}, p AS (SELECT doc_id, no, k, text, x0, CASE WHEN k % 4 = 1 THEN x0 + 40 ELSE x1 END AS x1, CASE k % 5 WHEN 0 THEN '**' WHEN 1 THEN '**' WHEN 2 THEN '*' ELSE '' END AS kind FROM w),
r AS (SELECT *, coalesce(x0 - lag(x1) OVER o BETWEEN 0 AND 0.79, false) AS glue, coalesce(kind <> lag(kind) OVER o, true) AS fresh FROM p WINDOW o AS (PARTITION BY doc_id, no ORDER BY k)),
i AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY doc_id, no ORDER BY k) AS run FROM r),
t AS (SELECT doc_id, no, run, CASE WHEN min(k) = 0 OR first(glue ORDER BY k) THEN '' ELSE ' ' END || any_value(kind) || string_agg(CASE WHEN fresh OR glue THEN '' ELSE ' ' END || text, '' ORDER BY k) || any_value(kind) AS t FROM i GROUP BY ALL)
SELECT doc_id, no, string_agg(t, '' ORDER BY run) AS text FROM t GROUP BY ALL""")
def styled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with marks around bold and italic runs."""
    k = F.col("k") % 5
    font = F.when(k == 0, "Times-Bold").when(k == 1, "Arial-Black").when(k == 2, "Times-Italic").otherwise("Times")
    rows = words(spark, sf_dir).withColumn("x1", F.when(F.col("k") % 4 == 1, F.col("x0") + 40).otherwise(F.col("x1"))).withColumn("font", font)
    return layout.style_runs(rows, ["doc_id", "no"])


_HARD = f"regexp_matches(c, '{P.SUBPART}') OR regexp_matches(c, '{P.OPTION}') OR regexp_matches(c, '{P.ANSWER_HINT}') OR starts_with(c, '**') OR ends_with(b, ':') OR ends_with(b, '**')"


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS no FROM documents),
m AS (SELECT doc_id, no, CASE no % 6 WHEN 1 THEN 'Answer: ' WHEN 2 THEN '(b) ' WHEN 4 THEN '**' ELSE '' END || s || CASE no % 6 WHEN 3 THEN ':' ELSE '' END AS s FROM l),
p AS (SELECT doc_id, no, trim(s, ' ') AS c, lag(rtrim(s, ' ')) OVER o AS b, max(length(s)) OVER (PARTITION BY doc_id) AS longest, row_number() OVER o AS r FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY no)),
j AS (SELECT doc_id, string_agg(CASE WHEN r = 1 THEN '' WHEN r = 2 OR {_HARD} OR length(b) < longest * 0.72::DOUBLE THEN '<br>' ELSE ' ' END || c, '' ORDER BY no) AS t FROM p GROUP BY doc_id)
SELECT doc_id, array_to_string(list_transform(string_split(t, '<br>'), lambda x: CASE WHEN regexp_matches(x, '{P.ANSWER_START}') THEN '<b class=''ans''>' || x || '</b>' ELSE x END), '<br>') AS text FROM j""")
def wrapped_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed lines as one text with their real breaks."""
    k = F.col("no") % 6
    s = F.concat(F.when(k == 1, "Answer: ").when(k == 2, "(b) ").when(k == 4, "**").otherwise(""), "s", F.when(k == 3, ":").otherwise(""))
    return layout.join_wrapped(lines(spark, sf_dir).select("doc_id", "no", s.alias("text")), ["doc_id"], "no", head=True)


@query("""WITH l AS (SELECT source, doc_id, CASE WHEN generate_subscripts(string_split(text, chr(10)), 1) = 1 THEN 'Page ' || doc_id || ' of ' || source ELSE unnest(string_split(text, chr(10))) END AS s, generate_subscripts(string_split(text, chr(10)), 1) AS no, len(string_split(text, chr(10))) AS n FROM documents),
b AS (SELECT source, doc_id, regexp_replace(lower(trim(s, ' ')), '\\d+', '#', 'g') AS form FROM l WHERE 800.0::DOUBLE * (no - 1) / n < 800 * 0.09::DOUBLE OR 800.0::DOUBLE * no / n > 800 * 0.92::DOUBLE),
c AS (SELECT source, form, count(DISTINCT doc_id) AS c FROM b GROUP BY ALL), t AS (SELECT source, count(DISTINCT doc_id) AS n FROM l GROUP BY ALL)
SELECT source, form, c, n FROM c JOIN t USING (source) WHERE n >= 2 AND c >= greatest(2, (n + 1) // 2)""")
def furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line forms in the top or bottom band of half of a source's documents; their first lines are numbered headers."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.size(F.split("text", "\n")).alias("n"), F.posexplode(F.split("text", "\n")).alias("i", "text"))
    y = lambda i: F.lit(800.0) * i / F.col("n")
    text = F.when(F.col("i") == 0, F.concat_ws(" ", F.lit("Page"), "doc_id", F.lit("of"), "source")).otherwise(F.col("text")).alias("text")
    segments = rows.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.lit("line").alias("kind"), text, y(F.col("i")).alias("y0"), y(F.col("i") + 1).alias("y1"), F.lit(800.0).alias("page_height"))
    return repeated.page_furniture(segments, P.TOP_BAND, P.BOTTOM_BAND).withColumnRenamed("doc_id", "source")


@query(f"""WITH {WORDS} SELECT doc_id, count(*) AS words, doc_id % 11 / 10.0::DOUBLE AS largest_image, doc_id % 13 = 0 AS is_image,
CASE WHEN doc_id % 13 = 0 OR (doc_id % 11 / 10.0::DOUBLE > 0.5 AND count(*) < 5) OR doc_id % 11 / 10.0::DOUBLE > 0.8 THEN 'ocr' ELSE 'typed' END AS mode FROM w GROUP BY doc_id""")
def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each page is read as type or as an image."""
    pages = words(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("words"))
    return layout.page_modes(pages.withColumn("largest_image", F.col("doc_id") % 11 / 10.0).withColumn("is_image", F.col("doc_id") % 13 == 0))


@query("""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
h AS (SELECT doc_id, no, 100 + length(s) % 900 AS h FROM l),
t AS (SELECT doc_id, no, 0 AS tile, h AS used FROM h WHERE no = 1
  UNION ALL SELECT h.doc_id, h.no, CASE WHEN used + h.h <= 1500 THEN tile ELSE tile + 1 END, CASE WHEN used + h.h <= 1500 THEN used + h.h ELSE h.h END FROM t JOIN h ON h.doc_id = t.doc_id AND h.no = t.no + 1)
SELECT doc_id, no::INTEGER AS no, tile FROM t""")
def strip_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips packed in order into tiles of bounded height."""
    strips = lines(spark, sf_dir).select("doc_id", "no", (100 + F.length("s") % 900).alias("height"))
    return review.tiles(strips, ["doc_id"], "no").select("doc_id", "no", "tile")


_MARKS = """m AS (SELECT doc_id, no, k, x0 - 12 AS x0, y0, x0 - 4 AS x1, y0 + 8 AS y1, k % 10 = 0 AS selected FROM w WHERE k % 5 = 0)"""


def _shapes(rows: DataFrame) -> DataFrame:
    """Marks left of every fifth word, every second of them filled and drawn twice."""
    some = rows.where("k % 5 = 0")
    shape = lambda r, a, b, c, d: r.select("doc_id", "no", (F.col("x0") - a).alias("x0"), (F.col("y0") + b).alias("y0"), (F.col("x0") - c).alias("x1"), (F.col("y0") + d).alias("y1"))
    twice = some.where("k % 10 = 0")
    return shape(some, 12, 0, 4, 8).unionByName(shape(twice, 11, 1, 3, 9)).unionByName(shape(twice, 10, 2, 6, 6))


@query(f"WITH {WORDS}, {_MARKS} SELECT doc_id, no, row_number() OVER (PARTITION BY doc_id, no ORDER BY x0)::INTEGER AS place, x0, y0, x1, y1, selected FROM m")
def choice_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radio buttons and whether each is filled."""
    marks = forms.choice_marks(_shapes(words(spark, sf_dir)), ["doc_id", "no"])
    return layout.reading_order(marks, ["doc_id", "no"]).drop("i")


@query(f"WITH {WORDS} SELECT doc_id, no, k // 5 + 1 AS place, true AS opt, string_agg(text, ' ' ORDER BY k) AS text FROM w GROUP BY ALL")
def choice_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with radio buttons, each option on its own."""
    rows = words(spark, sf_dir)
    marks = forms.choice_marks(_shapes(rows), ["doc_id", "no"])
    return forms.option_lines(rows.withColumn("line", F.lit(1)), marks, ["doc_id", "no"])


@query(f"""WITH {WORDS}, c AS (SELECT doc_id, no, min(x0) AS x0, string_agg(text, ' ' ORDER BY k) AS text FROM w GROUP BY ALL),
i AS (SELECT *, CASE WHEN no % 4 = 1 THEN no WHEN no % 4 = 2 THEN no - 1 ELSE no END AS owner FROM c),
g AS (SELECT doc_id, owner, bool_or(owner % 4 = 1) AS opt, string_agg(text, ' ' ORDER BY no) AS text FROM i GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY owner)::INTEGER AS place, opt, text FROM g""")
def wrapped_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options whose text goes on below: a mark stands before every fourth line, the line after it is close."""
    rows = words(spark, sf_dir)
    close = F.when(F.col("no") % 4 == 2, -185.0).otherwise(0.0)  # the second of four lines follows closely
    rows = rows.withColumn("y0", F.col("y0") * 10 + close).withColumn("y1", F.col("y0") + 10)
    first = rows.where("k = 0 and no % 4 = 1")
    marks = first.select("doc_id", F.col("no").alias("i"), (F.col("x0") - 12).alias("x0"), "y0", (F.col("x0") - 4).alias("x1"), (F.col("y0") + 8).alias("y1"))
    return forms.option_lines(rows.withColumnRenamed("no", "line"), marks, ["doc_id"])


@query(f"""WITH {WORDS}, f AS (SELECT doc_id, no, max(k) AS k FROM w GROUP BY ALL), b AS (SELECT doc_id, no, 30 + 40.0::DOUBLE * (k % 9) AS width FROM f),
n AS (SELECT b.doc_id, b.no, width, count(w.k) AS n FROM b LEFT JOIN w ON w.doc_id = b.doc_id AND w.no = b.no AND w.x0 >= 6 AND w.x1 <= 10 + width GROUP BY ALL)
SELECT doc_id, no, width FROM n WHERE width <= 320 AND n <= 4 AND NOT (doc_id % 4 = 0 AND no <= 2)""")
def entry_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Framed answer fields with few words, outside of tables."""
    rows = words(spark, sf_dir)
    size = rows.groupBy("doc_id", "no").agg(F.max("k").alias("k"))
    frames = size.select("doc_id", "no", F.lit(8.0).alias("x0"), (20.0 * F.col("no") - 5).alias("y0"), (38 + 40.0 * (F.col("k") % 9)).alias("x1"), (20.0 * F.col("no") + 15).alias("y1"))
    tables = rows.where("doc_id % 4 = 0 and no <= 2").select("doc_id", "no", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(900.0).alias("x1"), F.lit(60.0).alias("y1")).distinct()
    return forms.entry_boxes(frames, rows, tables, ["doc_id", "no"]).select("doc_id", "no", (F.col("x1") - F.col("x0")).alias("width"))


@query(f"""WITH {WORDS}, q AS (SELECT doc_id, max(x1) + 20 AS edge FROM w WHERE k % 3 = 0 AND no = 1 AND doc_id % 3 = 0 AND x0 < 600 * 0.3::DOUBLE GROUP BY doc_id)
SELECT doc_id, min(x0) - 2 AS margin FROM w JOIN q USING (doc_id) WHERE x0 > edge AND x0 < 300 GROUP BY doc_id""")
def margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the text begins right of a status column."""
    label = F.when((F.col("k") % 3 == 0) & (F.col("no") == 1) & (F.col("doc_id") % 3 == 0), "Question").otherwise(F.lower("text"))
    return forms.margin_column(words(spark, sf_dir).withColumn("text", label).withColumn("page_width", F.lit(600)), ["doc_id"])


_PRINT = """p AS (SELECT doc_id, no, k // 5 AS host, k, x0, CASE WHEN k % 5 = 4 THEN substr(text, 1, 2) ELSE text END AS text FROM w)"""


def _raised(rows: DataFrame) -> DataFrame:
    """Lines of five words, the last of them small and raised, on a line of its own."""
    small, row = F.col("k") % 5 == 4, F.floor(F.col("k") / 5)
    return rows.select(
        "doc_id", "no", (row * 2 + small.cast("int")).cast("int").alias("line"), (F.col("x0") - F.when(small, 38).otherwise(0)).alias("x0"), "x1",
        (30.0 * row).alias("y0"), (30.0 * row + F.when(small, 6).otherwise(10)).alias("y1"), F.when(small, 6.0).otherwise(10.0).alias("size"),
        F.when(small, F.substring("text", 1, 2)).otherwise(F.col("text")).alias("text"))


@query(f"""WITH {WORDS}, {_PRINT}
SELECT doc_id, no, host::INTEGER * 2 AS line, string_agg(text, ' ' ORDER BY CASE WHEN k % 5 = 4 THEN x0 - 38 ELSE x0 END) AS text FROM p GROUP BY ALL""")
def raised_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small raised words back in the lines they belong to."""
    rows = _raised(words(spark, sf_dir))
    merged = forms.merge_raised(rows, ["doc_id", "no"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ")
    return merged.groupBy("doc_id", "no", "line").agg(joined.alias("text"))


@query(f"""WITH {WORDS}, b AS (SELECT doc_id, no, k, x0 + 17 * (k // 4) - 8 * (k % 4) AS x0, x0 + 17 * (k // 4) - 8 * (k % 4) + 22 AS x1 FROM w),
g AS (SELECT *, coalesce(x0 - 12 > max(x1) OVER (PARTITION BY doc_id, no ORDER BY x0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM b),
i AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY doc_id, no ORDER BY x0) AS c FROM g)
SELECT doc_id, no, min(x0) AS x0, max(x1) AS x1, count(*)::INTEGER AS n FROM i GROUP BY doc_id, no, c""")
def box_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of each line merged while they are near each other."""
    k = F.col("k")
    x0 = F.col("x0") + 17 * F.floor(k / 4) - 8 * (k % 4)
    boxes = words(spark, sf_dir).select("doc_id", "no", x0.alias("x0"), "y0", (x0 + 22).alias("x1"), "y1")
    return layout.cluster_pages(boxes, ["doc_id", "no"]).select("doc_id", "no", "x0", "x1", "n")


@query(f"""WITH {WORDS}, j AS (SELECT doc_id, no, k, y0 + k % 3 * 0.5::DOUBLE AS y0 FROM w), g AS (SELECT *, coalesce(y0 - lag(y0) OVER o > 3, true) AS fresh FROM j WINDOW o AS (PARTITION BY doc_id ORDER BY y0, k)),
i AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY doc_id ORDER BY y0, k) - 1 AS line FROM g)
SELECT doc_id, line::INTEGER AS line, count(*) AS n, min(y0) AS top FROM i GROUP BY ALL""")
def word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words whose heights differ a little, as lines."""
    jitter = F.col("k") % 3 * 0.5
    rows = words(spark, sf_dir).select("doc_id", "x0", (F.col("y0") + jitter).alias("y0"), "x1", (F.col("y1") + jitter).alias("y1"))
    found = rows.groupBy("doc_id").applyInPandas(layout.group_words(), "doc_id long, x0 double, y0 double, x1 double, y1 double, line int")
    return found.groupBy("doc_id", "line").agg(F.count("*").alias("n"), F.min("y0").alias("top"))


@query(f"""WITH {WORDS}, b AS (SELECT doc_id, no, k, x0 + 45 * (k // 3) AS x0, x1 + 45 * (k // 3) AS x1 FROM w),
g AS (SELECT *, coalesce(x0 - 60 > max(x1) OVER (PARTITION BY doc_id, no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM b),
i AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY doc_id, no ORDER BY k) AS c FROM g)
SELECT doc_id, no, min(x0) AS x0, max(x1) AS x1 FROM i WHERE c = 1 GROUP BY ALL""")
def grown_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures at each line's first word, grown over the words level with them."""
    push = 45 * F.floor(F.col("k") / 3)
    rows = words(spark, sf_dir).withColumn("x0", F.col("x0") + push).withColumn("x1", F.col("x1") + push)
    figures = rows.where("k = 0").select("doc_id", "no", F.lit("f1").alias("id"), *forms.BOX)
    return layout.grow_figures(figures, rows, ["doc_id", "no"]).select("doc_id", "no", "x0", "x1")


@query(f"""WITH {WORDS}, s AS (SELECT doc_id, no, k, CASE WHEN k % 4 = 3 THEN NULL ELSE k % 4 END AS col FROM w WHERE no <= 3)
SELECT doc_id, no, k, row_number() OVER (PARTITION BY doc_id ORDER BY col NULLS LAST, no, k)::INTEGER AS place FROM s""")
def reading_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the first three printed lines in reading order: columns first, then top, then left."""
    rows = words(spark, sf_dir).where("no <= 3").withColumn("col", F.when(F.col("k") % 4 < 3, F.col("k") % 4))
    return layout.reading_order(rows, ["doc_id"], "col").select("doc_id", "no", "k", "place")
