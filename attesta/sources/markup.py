"""Readers: marked-up sources, tables, plain text, JSON folders, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from attesta.functions import patterns as P
from attesta.functions.text import suffix_kind


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as ``(path, text)``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def physical_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each line, numbered from one, without white space at its end."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("i", "raw")).select(key, (F.col("i") + 1).alias("no"), F.rtrim(F.regexp_replace("raw", r"\s+$", "")).alias("text"))


def _carry(name: Column, window) -> Column:
    return F.last(name, ignorenulls=True).over(window)


def source_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Records of marked-up sources: key, no, text, page, kind, table_id, fig, opt.

    The open page, table and option list of a line are those of the latest line
    that set them: running windows over each document, no loop. A table's rows
    are data whatever they look like, so a line counts as opening or closing
    only by the table state before it.
    """
    rows = physical_lines(docs, key, text)
    before = Window.partitionBy(key).orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key).orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    t = F.col("text")
    meta = (F.col("no") == 1) & t.startswith("#!")
    page_no = F.regexp_extract(t, P.PAGE, 1)
    is_page = ~meta & t.rlike(P.PAGE)
    ignored = ~meta & ~is_page & t.startswith("#~")
    opens, closes = t.rlike(P.TABLE_OPEN) & ~meta & ~is_page & ~ignored, (t == P.TABLE_CLOSE) & ~meta
    mark = F.when(opens, F.regexp_extract(t, P.TABLE_OPEN, 1)).when(closes, F.lit(""))
    rows = rows.select(
        key, "no", "text", F.coalesce(_carry(F.when(is_page, F.regexp_extract(t, P.PAGE, 1).try_cast("int")), upto), F.lit(1)).alias("page"),
        F.nullif(_carry(mark, before), F.lit("")).alias("open_table"), meta.alias("m"), is_page.alias("p"), ignored.alias("g"), opens.alias("o"), closes.alias("c"), page_no.alias("pn"))
    in_table = F.col("open_table").isNotNull()
    kind = (
        F.when(F.col("m"), "meta").when(F.col("p"), "page").when(F.col("g"), "ignored").when(F.col("o") | F.col("c"), "directive").when(in_table, "table_row")
        .when(t.rlike(P.FIGURE), "figure").when(t.rlike(P.KEY_LINE), "key").when(t.rlike(P.DIRECTIVE), "directive").when(F.trim(t) == "", "blank").otherwise("text")
    )
    rows = rows.withColumn("kind", kind)
    switch = F.when(F.col("kind") == "directive", F.when(t == "[[options]]", True).when((t == "[[/options]]") | (t == "[[item]]") | t.startswith("[[part"), False))
    fig = F.when(F.col("kind") == "figure", F.struct(F.regexp_extract(t, P.FIGURE, 1).alias("id"), F.nullif(F.regexp_extract(t, P.FIGURE, 2), F.lit("")).alias("src")))
    return rows.select(
        key, "no", F.when(F.col("kind") == "key", F.regexp_extract(t, P.KEY_LINE, 1)).otherwise(t).alias("text"), "page", "kind",
        F.when(F.col("o"), F.regexp_extract(t, P.TABLE_OPEN, 1)).when(F.col("c") | (F.col("kind") == "table_row"), F.col("open_table")).alias("table_id"), fig.alias("fig"),
        ((F.col("kind") == "text") & F.coalesce(_carry(switch, before), F.lit(False))).alias("opt"))


def provenance(text: Column | str) -> Column:
    """Key and value pairs of a source's first line."""
    first = F.substring_index(F.col(text) if isinstance(text, str) else text, "\n", 1)
    keys, values = (F.regexp_extract_all(first, F.lit(r"(\w+)=(\S+)"), F.lit(i)) for i in (1, 2))
    return F.when(first.startswith("#!"), F.map_from_entries(F.arrays_zip(keys, values))).otherwise(F.create_map().cast("map<string,string>"))


def content(lines: DataFrame) -> DataFrame:
    """Lines whose words belong to the document."""
    return lines.where(F.col("kind").isin("text", "table_row"))


def line_span(lines: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Content lines within each span ``(key, lo, hi, ...)``, ends included."""
    return content(lines).join(spans, key).where((F.col("no") >= F.col("lo")) & (F.col("no") <= F.col("hi")))


def objects_in_span(lines: DataFrame, spans: DataFrame, key: str = "doc_id", owner: str = "item") -> DataFrame:
    """Tables (counted where they open) and figures of each span."""
    found = objects_met(lines, spans, key, owner)
    return spans.select(key, owner).distinct().join(found, [key, owner], "left").select(
        key, owner, *(F.coalesce(F.array_sort(c), F.array().cast("array<string>")).alias(c) for c in ("tables", "figures")))


def objects_met(lines: DataFrame, spans: DataFrame, key: str = "doc_id", owner: str = "item") -> DataFrame:
    """The same of spans that have any: only lines that open a table or are a figure meet the spans."""
    opened = (F.col("kind") == "directive") & F.col("text").startswith("[[table")
    marks = lines.select(key, "no", F.when(opened, F.col("table_id")).alias("_table"), F.when(F.col("kind") == "figure", F.col("fig.id")).alias("_figure")).where("_table is not null or _figure is not null")
    inside = marks.join(spans, key).where((F.col("no") >= F.col("lo")) & (F.col("no") <= F.col("hi")))
    return inside.groupBy(key, owner).agg(F.collect_set("_table").alias("tables"), F.collect_set("_figure").alias("figures"))


def line_ordinals(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Text lines with their ordinal on their page."""
    return lines.where("kind = 'text'").withColumn("k", F.row_number().over(Window.partitionBy(key, "page").orderBy("no")))


def line_boxes(lines: DataFrame, boxes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Boxes of text lines by page and ordinal; ``boxes``: key, page, k, x0, y0, x1, y1."""
    return line_ordinals(lines, key).select(key, "page", "k", "no").join(boxes, [key, "page", "k"])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Delimited files with quoting, every field as text."""
    return spark.read.csv(path, header=False, inferSchema=False, multiLine=True, escape='"')


def read_json_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object or a list of them in each file of a folder, in the order of their paths."""
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("_file", F.col("_metadata.file_path")).orderBy("_file")


def route(paths: DataFrame, path: str = "path") -> DataFrame:
    """Input files by kind."""
    return paths.withColumn("kind", suffix_kind(path))


def read_book(data: bytes) -> list[tuple[str, int, list[str]]]:
    """``(sheet, row, cells)`` of a workbook: its archive has one XML file a sheet and one of shared strings."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    bare = lambda x: x.rsplit("}", 1)[-1]
    said = lambda e: "".join(t.text or "" for t in e.iter() if bare(t.tag) == "t")
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        tree = lambda name: ElementTree.fromstring(book.read(name))
        shared = [said(e) for e in tree("xl/sharedStrings.xml") if bare(e.tag) == "si"] if "xl/sharedStrings.xml" in book.namelist() else []
        target = {e.get("Id"): e.get("Target") for e in tree("xl/_rels/workbook.xml.rels")}
        out = []
        for sheet in (e for e in tree("xl/workbook.xml").iter() if bare(e.tag) == "sheet"):
            path = target[next(v for k, v in sheet.attrib.items() if bare(k) == "id")]
            rows = tree(path.lstrip("/") if path.startswith("/") else f"xl/{path}")
            for i, row in enumerate(e for e in rows.iter() if bare(e.tag) == "row"):
                cells: list[str] = []
                for c in (e for e in row if bare(e.tag) == "c"):
                    letters = re.match(r"[A-Z]*", c.get("r") or "")[0]
                    place = 0
                    for x in letters:
                        place = place * 26 + ord(x) - 64
                    cells += [""] * (place - 1 - len(cells))
                    value = next((e.text or "" for e in c if bare(e.tag) == "v"), "")
                    cells.append(shared[int(value)] if c.get("t") == "s" else said(c) if c.get("t") == "inlineStr" else value)
                if any(cells):
                    out.append((sheet.get("name"), int(row.get("r") or i + 1), cells))
    return out


def sheet_rows(batches):
    """Rows of spreadsheets from binary files, for ``mapInPandas``: path, sheet, row, cells as stored."""
    import pandas as pd

    for frame in batches:
        out = [(path, *row) for path, data in zip(frame["path"], frame["content"], strict=True) for row in read_book(data)]
        yield pd.DataFrame(out, columns=["path", "sheet", "row", "cells"])


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Spreadsheet rows of all matching files; a file is one unit of work."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(sheet_rows, "path string, sheet string, row int, cells array<string>")


def emit_source(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, place, line)``: segments of pages as lines of a marked-up source.

    ``segments``: key, page, place, kind (line, key, margin, blank, table,
    figure), text, opt, ignored, id, src, rows and num. A page begins with its
    number; option lists are opened and closed where lines with ``opt`` begin and end.
    """
    order = Window.partitionBy(key).orderBy("page", "place")
    on_page = Window.partitionBy(key, "page").orderBy("place")
    opt = (F.col("kind") == "line") & F.coalesce("opt", F.lit(False))
    rows = segments.withColumn("o", opt)
    rows = rows.withColumn("was", F.coalesce(F.lag("o").over(on_page), F.lit(False))).withColumn("first", F.row_number().over(on_page) == 1)
    rows = rows.withColumn("ends", F.lead("o").over(on_page).isNull() & F.col("o")).withColumn("n", F.row_number().over(order))
    only = lambda c, *x: F.when(c, F.array(*x)).otherwise(F.array().cast("array<string>"))
    kind, text = F.col("kind"), F.coalesce("text", F.lit(""))
    own = (
        F.when(kind == "margin", F.concat(only(F.col("num").isNotNull(), F.concat(F.lit("[[item "), F.col("num"), F.lit("]]"))), F.array(F.concat(F.lit("#~ "), text))))
        .when(kind == "blank", F.concat(F.array(F.lit("[[blank]]")), only(text != "", F.concat(F.lit("#~ [entry] "), text))))
        .when(kind == "key", F.array(F.concat(F.lit("[[key]] "), text)))
        .when(kind == "table", F.concat(F.array(F.concat(F.lit("[[table "), F.col("id"), F.lit("]]"))), F.transform("rows", lambda r: F.array_join(r, "\t")), F.array(F.lit("[[/table]]"))))
        .when(kind == "figure", F.array(F.concat(F.concat_ws(" ", F.lit("[[figure"), F.col("id"), F.col("src")), F.lit("]]"))))
        .otherwise(F.array(F.concat(F.when(F.coalesce("ignored", F.lit(False)), "#~ ").otherwise(""), text)))
    )
    lines = F.concat(
        only(F.col("first"), F.concat(F.lit("=== page "), F.col("page"), F.lit(" ==="))), only(F.col("was") & ~F.col("o"), F.lit("[[/options]]")), only(F.col("o") & ~F.col("was"), F.lit("[[options]]")), own,
        only(F.col("ends"), F.lit("[[/options]]")))
    spread = rows.select(key, "n", F.posexplode(lines).alias("i", "line"))
    return spread.select(key, F.row_number().over(Window.partitionBy(key).orderBy("n", "i")).alias("place"), "line")
