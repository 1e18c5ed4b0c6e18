"""What reviewers need: changed lines, boxes of spans, summaries, flattened records, workings."""

from __future__ import annotations

import ast
import difflib
import math
import operator
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from attesta.functions import patterns as P
from attesta.functions.text import slug
from attesta.session import materialise, scratch_dir


def changed_lines(edited: DataFrame, raw: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, no)`` of lines that differ from the untouched text, by an exact line diff of each document."""
    kind = dict(edited.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, new, old in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ops = difflib.SequenceMatcher(None, old.split("\n"), new.split("\n"), autojunk=False).get_opcodes()
                rows += [(i, no) for tag, _, _, a, b in ops if tag != "equal" for no in range(a + 1, b + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field(0).type), pa.array([r[1] for r in rows], pa.int32())], [key, "no"])

    both = edited.select(key, F.col("text").alias("new")).join(raw.select(key, F.col("text").alias("old")), key).where("new is not null and old is not null")
    return both.mapInArrow(run, f"{key} {kind}, no int")


def touched(spans: DataFrame, changed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans ``(key, lo, hi, ...)`` that hold a changed line."""
    c = changed.select(F.col(key).alias("_k"), "no")
    return spans.join(c, (spans[key] == c["_k"]) & (c["no"] >= spans["lo"]) & (c["no"] <= spans["hi"]), "left_semi")


def span_boxes(spans: DataFrame, boxes: DataFrame, owner: list[str], key: str = "doc_id") -> DataFrame:
    """The box around a span's lines on each of its pages; ``boxes`` has key, no, page and x0, y0, x1, y1."""
    inside = spans.join(boxes, key).where((F.col("no") >= F.col("lo")) & (F.col("no") <= F.col("hi")))
    return inside.groupBy(*owner, "page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def tiles(strips: DataFrame, keys: list[str], order: str, height: str = "height", most: int = 1500) -> DataFrame:
    """Strips in order, a new tile where the next one wouldn't fit; adds ``tile``.

    The fold runs over one group's heights in an array.
    """
    rows = strips.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, height))).alias("s"))
    start = F.struct(F.lit(0).alias("tile"), F.lit(0.0).alias("used"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        h = s[height].cast("double")
        fits = (a["used"] == 0) | (a["used"] + h <= most)
        tile = F.when(fits, a["tile"]).otherwise(a["tile"] + 1)
        return F.struct(tile.alias("tile"), F.when(fits, a["used"] + h).otherwise(h).alias("used"), F.concat(a["out"], F.array(tile)).alias("out"))

    folded = rows.select(*keys, "s", F.aggregate("s", start, step)["out"].alias("t"))
    placed = folded.select(*keys, F.explode(F.arrays_zip("s", "t")).alias("x")).select(*keys, F.col(f"x.s.{order}").alias(order), F.col("x.t").alias("tile"))
    return strips.join(placed, [*keys, order])


def summary(files: DataFrame, pages: DataFrame, views: DataFrame) -> DataFrame:
    """One row for each file: pages, modes, images and what they cost."""
    p = pages.groupBy("id").agg(F.count("*").alias("pages"), F.array_join(F.array_sort(F.collect_set("mode")), "/").alias("modes"))
    v = views.groupBy("id").agg(F.count("*").alias("images"), F.sum("tokens").alias("tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return files.join(p, "id", "left").join(v, "id", "left").select("id", "role", zero("pages"), F.coalesce("modes", F.lit("text")).alias("modes"), zero("images"), zero("tokens"))


def solutions_of(files: DataFrame) -> DataFrame:
    """Papers with the solutions that are paired with them; ``files``: id, role, pair."""
    lists = files.where("pair is not null").groupBy(F.col("pair").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("solutions"))
    return files.where("role = 'paper'").join(lists, "id", "left").select("id", F.coalesce("solutions", F.array().cast("array<string>")).alias("solutions"))


def unique_ids(rows: DataFrame, name: str, order: str, taken: DataFrame | None = None) -> DataFrame:
    """``id`` for each row: a slug, with _2, _3 and so on; ids in ``taken`` (and slugs of the rows) are stepped over.

    Of the first names of a group, as many as it has rows and as there are ids
    of its kind already, those that are free are dealt out in order.
    """
    base = rows.withColumn("_base", slug(name))
    own = base.select(F.col("_base").alias("id"), F.lit(False).alias("_old"))
    held = own if taken is None else own.unionByName(taken.select("id", F.lit(True).alias("_old")))
    held = held.groupBy("id").agg(F.max("_old").alias("_old"))
    kind = F.regexp_replace("id", r"_\d+$", "")
    near = held.groupBy(kind.alias("_base")).agg(F.count("*").alias("_c"))
    sizes = base.groupBy("_base").agg(F.count("*").alias("_n")).join(near, "_base", "left")
    names = sizes.select("_base", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n") + F.coalesce("_c", F.lit(0)) + 1)).alias("_k"))
    names = names.select("_base", "_k", F.when(F.col("_k") == 1, F.col("_base")).otherwise(F.concat_ws("_", "_base", "_k")).alias("id"))
    # The bare slug is free unless it was taken before; a numbered one must be no other row's slug either.
    free = names.join(held, "id", "left").where(F.col("_old").isNull() | ((F.col("_k") == 1) & ~F.col("_old")))
    dealt = free.withColumn("_r", F.row_number().over(Window.partitionBy("_base").orderBy("_k"))).select("_base", "_r", "id")
    ranked = base.withColumn("_r", F.row_number().over(Window.partitionBy("_base").orderBy(order)))
    return ranked.join(dealt, ["_base", "_r"]).drop("_base", "_r")


#: Fields that are private besides those that begin with an underscore; how deep records may be nested.
_PRIVATE, DEEPEST = ("src", "e_src"), 24


def flatten_json(rows: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, path, text)`` of all strings in JSON, but for private fields; text that is no JSON gives none.

    Each round opens one more level of all records at once, until none is
    left; records nested deeper than ``DEEPEST`` raise.
    """
    level = rows.select(key, F.lit("").alias("path"), F.try_parse_json(column).alias("v")).where("v is not null")
    out, root = None, scratch_dir(rows.sparkSession)
    for depth in range(DEEPEST + 1):
        level = materialise(level.select(key, "path", F.to_json("v").alias("j")), f"{root}/{depth}").select(key, "path", F.parse_json("j").alias("v"))
        kind = F.schema_of_variant("v")
        strings = level.where(kind == "STRING").select(key, "path", F.try_variant_get("v", "$", "string").alias("text"))
        out = strings if out is None else out.unionByName(strings)
        if depth == DEEPEST and level.where(kind.startswith("OBJECT") | kind.startswith("ARRAY")).limit(1).count():
            raise ValueError("records are nested too deeply")
        nested = level.where(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        if not nested.limit(1).count():
            return out
        nested.createOrReplaceTempView("_attesta_level")
        opened = nested.sparkSession.sql(f"SELECT l.`{key}`, l.path, e.pos, e.key AS name, e.value AS v FROM _attesta_level l, LATERAL variant_explode(l.v) e")
        step = F.when(F.col("name").isNull(), F.concat("path", F.lit("["), "pos", F.lit("]"))).when(F.col("path") == "", F.col("name")).otherwise(F.concat("path", F.lit("."), "name"))
        level = opened.where(F.col("name").isNull() | ~(F.col("name").startswith("_") | F.col("name").isin(*_PRIVATE))).select(key, step.alias("path"), "v")
    return out


def where_of(path: Column) -> Column:
    """A path as people read it: kind of record, its place, and the field."""
    kind = F.regexp_extract(path, r"^(papers|concepts|questions)\[(\d+)\](.*)", 1)
    place, rest = (F.regexp_extract(path, r"^(papers|concepts|questions)\[(\d+)\](.*)", i) for i in (2, 3))
    return F.when(kind == "", path).otherwise(F.concat(F.regexp_replace(kind, "s$", ""), F.lit(" "), (place.cast("int") + 1).cast("string"), rest))


def bad_macros(macros: Column | str) -> Column:
    """Names of a map of macros that aren't a backslash and letters."""
    return F.filter(F.map_keys(macros), lambda k: ~k.rlike(P.MACRO_NAME))


def chosen_sections(text: str) -> list[str]:
    """Sections by any of their names, in the order given, each once; an unknown one raises."""
    known = {alias: name for name, aliases in P.SECTION_NAMES.items() for alias in aliases}
    words = [w for w in re.split(r"[,\s]+", text.strip().lower()) if w]
    if unknown := [w for w in words if w not in known]:
        raise ValueError(f"unknown sections {unknown}; there are {', '.join(P.SECTION_NAMES)}")
    return list(dict.fromkeys(known[w] for w in words))


_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow}
_FUNCTIONS = {"SQRT": math.sqrt, "MIN": min, "MAX": max, "SUM": lambda *x: sum(x), "ABS": abs, "EXP": math.exp, "LN": math.log, "ROUND": round, "AVERAGE": lambda *x: sum(x) / len(x)}


def calculate(rows: list[str]) -> list[float | None]:
    """Values of a column of cells B1, B2, ...: numbers, and formulas of arithmetic and a few functions.

    What can't be computed (unknown names, cycles, faults) is null.
    """
    done: dict[int, float | None] = {}

    def cell(i: int, above: frozenset[int]) -> float:
        if i in above or not 1 <= i <= len(rows):
            raise ValueError(i)
        if i not in done:
            text = rows[i - 1] or ""
            try:
                done[i] = node(ast.parse(text[1:].replace("^", "**"), mode="eval").body, above | {i}) if text.startswith("=") else float(text.replace(",", ""))
            except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, TypeError, KeyError):
                done[i] = None
        if done[i] is None:
            raise ValueError(i)
        return done[i]

    def node(x: ast.expr, above: frozenset[int]) -> float:
        if isinstance(x, ast.Constant) and isinstance(x.value, (int, float)):
            return float(x.value)
        if isinstance(x, ast.Name) and (m := re.fullmatch(r"B(\d+)", x.id)):
            return cell(int(m[1]), above)
        if isinstance(x, ast.UnaryOp) and isinstance(x.op, ast.USub):
            return -node(x.operand, above)
        if isinstance(x, ast.BinOp):
            return _OPERATORS[type(x.op)](node(x.left, above), node(x.right, above))
        if isinstance(x, ast.Call) and isinstance(x.func, ast.Name):
            return float(_FUNCTIONS[x.func.id.upper()](*(node(a, above) for a in x.args)))
        raise ValueError(x)

    out = []
    for i in range(1, len(rows) + 1):
        try:
            out.append(cell(i, frozenset()))
        except ValueError:
            out.append(None)
    return out


def workings(calcs: DataFrame, key: str = "id") -> DataFrame:
    """``(key, values)`` of workings; ``calcs`` has key and ``cells``, an array of text."""
    kind = dict(calcs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([calculate(c or []) for c in batch.column(1).to_pylist()], pa.list_(pa.float64()))], [key, "values"])

    return calcs.select(key, "cells").mapInArrow(run, f"{key} {kind}, `values` array<double>")


def table_shape(tables: DataFrame) -> DataFrame:
    """Tables whose rows aren't as wide as their head, or whose groups don't span it; ``tables``: id, head, rows, spans."""
    width = F.size("head")
    rows = F.exists("rows", lambda r: F.size(r) != width)
    spans = F.col("spans").isNotNull() & (F.aggregate("spans", F.lit(0), lambda a, s: a + s) != width)
    return tables.select("id", rows.alias("ragged"), F.coalesce(spans, F.lit(False)).alias("spans_differ")).where("ragged or spans_differ")


def block_faults(blocks: DataFrame) -> DataFrame:
    """Blocks of unknown types, definitions that aren't pairs, boxes without a title; ``blocks``: id, t, title, pairs."""
    fault = F.when(~F.col("t").isin(*P.BLOCK_TYPES), "unknown type").when((F.col("t") == "defs") & F.exists("pairs", lambda p: F.size(p) != 2), "not pairs").when((F.col("t") == "box") & (F.coalesce("title", F.lit("")) == ""), "no title")
    return blocks.select("id", fault.alias("fault")).where("fault is not null")
