"""Answer forms on printed pages: marks, boxes, margins, raised text, figures and their labels.

Shapes and words are rows with a page's keys and x0, y0, x1, y1; joins are
within a page, which has a few hundred of either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from attesta.operators.layout import contained

BOX = ("x0", "y0", "x1", "y1")


def _sides(left: str, right: str) -> tuple[tuple, tuple]:
    return tuple(F.col(f"{left}.{c}") for c in BOX), tuple(F.col(f"{right}.{c}") for c in BOX)


def _same_page(page: list[str], left: str, right: str):
    on = F.lit(True)
    for k in page:
        on = on & (F.col(f"{left}.{k}") == F.col(f"{right}.{k}"))
    return on


def choice_marks(shapes: DataFrame, page: list[str]) -> DataFrame:
    """Radio buttons and check boxes, and whether each is filled; of shapes drawn on one another the first counts."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    order = Window.partitionBy(*page).orderBy(F.round("y0"), "x0", "x1", "y1")
    marks = shapes.where(w.between(6, 13) & h.between(6, 13) & (F.abs(w - h) < 1.6)).select(*page, *BOX).withColumn("i", F.row_number().over(order))
    earlier = marks.alias("o")
    own = marks.alias("m").join(earlier, _same_page(page, "m", "o") & (F.col("o.i") < F.col("m.i")) & (F.abs(F.col("o.x0") - F.col("m.x0")) < 2.5) & (F.abs(F.col("o.y0") - F.col("m.y0")) < 2.5), "left_anti")
    dots = shapes.where((w >= 3) & (w < 6) & (F.abs(w - h) < 1.2)).select(*page, *BOX).alias("d")
    a, b = _sides("d", "m")
    inside = (a[0] > b[0]) & (a[2] < b[2]) & (a[1] > b[1]) & (a[3] < b[3])
    filled = own.alias("m").join(dots, _same_page(page, "m", "d") & inside, "left_semi").select(*page, "i").withColumn("selected", F.lit(True))
    return own.join(filled, [*page, "i"], "left").select(*page, "i", *BOX, F.coalesce("selected", F.lit(False)).alias("selected"))


def _marked_lines(words: DataFrame, marks: DataFrame, page: list[str]) -> tuple[DataFrame, DataFrame]:
    """Boxes of lines, and the marks on each: ``page, line, i, mx, from, until, solo``."""
    lines = words.groupBy(*page, "line").agg(F.min("y0").alias("top"), F.max("y1").alias("bottom"), F.min("x0").alias("left"), F.max("x1").alias("right"))
    middle = (F.col("top") + F.col("bottom")) / 2
    at = lines.alias("l").join(marks.alias("m"), _same_page(page, "l", "m") & (middle >= F.col("m.y0") - 3) & (middle <= F.col("m.y1") + 3) & (F.col("m.x0") < F.col("l.right")) & (F.col("m.x1") > F.col("l.left") - 18))
    row = at.select(*(F.col(f"l.{k}").alias(k) for k in page), "line", "i", F.col("m.x1").alias("from"), F.col("m.x0").alias("mx"))
    order = Window.partitionBy(*page, "line")
    return lines, row.withColumn("until", F.coalesce(F.lead("mx").over(order.orderBy("mx")), F.lit(1e9))).withColumn("solo", F.count("*").over(order) == 1)


def _text() -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ")


def option_words(words: DataFrame, marks: DataFrame, page: list[str]) -> DataFrame:
    """Words of each option: those right of a mark on its line, up to the next mark there; ``words`` has ``line``, ``marks`` has ``i``."""
    row = _marked_lines(words, marks, page)[1]
    found = words.join(row, [*page, "line"]).where((F.col("x0") >= F.col("from") - 1) & (F.col("x0") < F.col("until")))
    return found.groupBy(*page, "line", "i").agg(_text().alias("text"))


def option_lines(words: DataFrame, marks: DataFrame, page: list[str]) -> DataFrame:
    """Lines of a page with each option on its own: ``page, place, opt, text``.

    Words before a line's first mark are a line of their own. A line without
    marks that goes on below an option that is alone on its line, at its left
    edge and close to it, belongs to that option.
    """
    lines, row = _marked_lines(words, marks, page)
    first = row.groupBy(*page, "line").agg(F.min(F.struct("mx", "from"))["from"].alias("lead"))
    known = words.join(first, [*page, "line"], "left")
    size = [F.min("x0").alias("x0"), F.max("y0").alias("last_top"), _text().alias("text")]
    plain = known.where("lead is null").groupBy(*page, "line").agg(*size).withColumn("part", F.lit(-1.0)).withColumn("opt", F.lit(False)).withColumn("solo", F.lit(False))
    lead = known.where(F.col("x1") <= F.col("lead") - 1).groupBy(*page, "line").agg(*size).withColumn("part", F.lit(-1.0)).withColumn("opt", F.lit(False)).withColumn("solo", F.lit(False))
    found = words.join(row, [*page, "line"]).where((F.col("x0") >= F.col("from") - 1) & (F.col("x0") < F.col("until")))
    options = found.groupBy(*page, "line", F.col("mx").alias("part"), "solo").agg(*size).withColumn("opt", F.lit(True))
    pieces = plain.withColumn("plain", F.lit(True)).unionByName(lead.withColumn("plain", F.lit(False))).unionByName(options.withColumn("plain", F.lit(False)))
    pieces = pieces.join(lines, [*page, "line"])
    fields = ["top", "line", "part", "x0", "bottom", "plain", "opt", "solo", "text"]
    pages = pieces.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("s"))
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("open"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("top"), F.lit(0.0).alias("bottom"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        joins = s["plain"] & a["open"] & (F.abs(s["x0"] - a["x0"]) < 3) & (s["top"] - a["bottom"] < (a["bottom"] - a["top"]) * 1.2)
        n = F.when(joins, a["n"]).otherwise(a["n"] + 1)
        return F.struct(
            n.alias("n"), (joins | (s["opt"] & s["solo"])).alias("open"), F.when(joins, a["x0"]).otherwise(s["x0"]).alias("x0"),
            F.when(joins, a["top"]).otherwise(s["top"]).alias("top"), s["bottom"].alias("bottom"), F.concat(a["out"], F.array(n)).alias("out"))

    placed = pages.select(*page, "s", F.aggregate("s", start, step)["out"].alias("t")).select(*page, F.posexplode(F.arrays_zip("s", "t")).alias("k", "x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.col("x.s.text").alias("text")))), lambda x: x["text"]), " ")
    return placed.groupBy(*page, F.col("x.t").alias("place")).agg(F.max("x.s.opt").alias("opt"), joined.alias("text"))


def entry_boxes(shapes: DataFrame, words: DataFrame, tables: DataFrame, page: list[str]) -> DataFrame:
    """Framed answer fields: of a field's size, with four words at most, and no cell of a table."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    boxes = shapes.where(h.between(18, 34) & w.between(30, 320)).select(*page, *BOX).distinct()
    a, b = _sides("b", "t")
    free = boxes.alias("b").join(tables.select(*page, *BOX).alias("t"), _same_page(page, "b", "t") & contained(a, b, 2), "left_anti")
    a, b = _sides("w", "b")
    full = free.alias("b").join(words.select(*page, *BOX).alias("w"), _same_page(page, "b", "w") & contained(a, b, 2)).groupBy(*(F.col(f"b.{c}").alias(c) for c in (*page, *BOX))).agg(F.count("*").alias("n")).where("n > 4")
    return free.join(full, [*page, *BOX], "left_anti")


def margin_column(words: DataFrame, page: list[str], width: str = "page_width") -> DataFrame:
    """Where the text begins right of a status column at the left margin; pages without one have no row."""
    edge = words.where((F.col("text") == "Question") & (F.col("x0") < F.col(width) * 0.3)).groupBy(*page).agg((F.max("x1") + 20).alias("edge"))
    right = words.join(edge, page).where((F.col("x0") > F.col("edge")) & (F.col("x0") < F.col(width) * 0.5))
    return right.groupBy(*page).agg((F.min("x0") - 2).alias("margin"))


def raised_text(words: DataFrame, page: list[str]) -> DataFrame:
    """Lines of up to three small words and the line each belongs to: ``line, host``; ``words`` has ``line`` and ``size``."""
    middle = words.groupBy(*page).agg(F.median("size").alias("median"))
    lines = words.join(middle, page).groupBy(*page, "line").agg(
        F.every(F.col("size") < F.col("median") * 0.85).alias("small"), F.some(F.col("size") < F.col("median") * 0.85).alias("any_small"), F.count("*").alias("n"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    s, o = lines.where("small and n <= 3").alias("s"), lines.where("not any_small").alias("o")
    near = F.abs((F.col("o.y0") + F.col("o.y1")) / 2 - (F.col("s.y0") + F.col("s.y1")) / 2) <= 7
    pairs = s.join(o, _same_page(page, "s", "o") & near & F.col("s.x0").between(F.col("o.x0"), F.col("o.x1") + 2))
    return pairs.groupBy(*(F.col(f"s.{k}").alias(k) for k in page), F.col("s.line").alias("line")).agg(F.min("o.line").alias("host"))


def merge_raised(words: DataFrame, page: list[str]) -> DataFrame:
    """Words with small raised or lowered ones back in their lines: ``page, line, x0, text``, one row a word.

    A small word within a wider one goes into it before the first character
    right of its left edge, where ``words`` has ``chars`` (an array of left
    edges); others stand between words by their left edge.
    """
    small = raised_text(words, page)
    own = words.join(small.select(*page, "line").distinct(), [*page, "line"], "left_anti")
    moved = words.join(small, [*page, "line"]).select(*page, F.col("host").alias("line"), "x0", "text")
    if "chars" not in words.columns:
        return own.select(*page, "line", "x0", "text").unionByName(moved)
    s, o = moved.alias("s"), own.alias("o")
    into = _same_page(page, "s", "o") & (F.col("s.line") == F.col("o.line")) & (F.col("o.x0") < F.col("s.x0")) & (F.col("s.x0") < F.col("o.x1") - 0.5) & (F.size("o.chars") > 0)
    inner = s.join(o, into).select(*(F.col(f"o.{c}").alias(c) for c in (*page, "line", "x0", "text", "chars")), F.col("s.x0").alias("sx"), F.col("s.text").alias("st"))
    place = F.size(F.filter("chars", lambda c: c < F.col("sx") - 0.5))
    grouped = inner.withColumn("at", place).groupBy(*page, "line", "x0", "text").agg(F.sort_array(F.collect_list(F.struct("at", "sx", "st")), asc=False).alias("in"))
    put = F.aggregate("in", F.col("text"), lambda t, i: F.concat(F.substring(t, F.lit(1), i["at"]), i["st"], F.substring(t, i["at"] + 1, F.length(t))))
    filled = grouped.select(*page, "line", "x0", put.alias("text"))
    free = moved.join(inner.select(*page, "line", F.col("sx").alias("x0")).distinct(), [*page, "line", "x0"], "left_anti")
    rest = own.select(*page, "line", "x0", "text").join(grouped.select(*page, "line", "x0", "text"), [*page, "line", "x0", "text"], "left_anti")
    return rest.unionByName(filled).unionByName(free)
