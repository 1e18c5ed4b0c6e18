"""Lines that repeat over most members of a group (headers and footers)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def line_form(text: Column | str) -> Column:
    """A line's form: trimmed, lower case, digit runs as one mark."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.lower(F.trim(text)), r"\d+", "#")


def repeated_forms(lines: DataFrame, group: str, member: str, text: str = "text", share: float = 0.5, least: int = 2) -> DataFrame:
    """Forms that stand in at least ``max(least, floor((n + 1) * share))`` of a group's ``n`` members.

    A form counts once for each member.
    """
    forms = lines.select(group, member, line_form(text).alias("form")).where("form <> ''").distinct()
    sizes = lines.groupBy(group).agg(F.countDistinct(member).alias("n"))
    counts = forms.groupBy(group, "form").agg(F.count("*").alias("c"))
    need = F.greatest(F.lit(least), F.floor((F.col("n") + 1) * share))
    return counts.join(sizes, group).where((F.col("n") >= 2) & (F.col("c") >= need)).select(group, "form", "c", "n")


def page_furniture(segments: DataFrame, top: float, bottom: float) -> DataFrame:
    """Repeated lines within the top or bottom band of a document's pages.

    ``segments``: doc_id, page, kind, text, y0, y1, page_height.
    """
    band = (F.col("y0") < F.col("page_height") * top) | (F.col("y1") > F.col("page_height") * bottom)
    pages = segments.groupBy("doc_id").agg(F.countDistinct("page").alias("n"))
    forms = segments.where((F.col("kind") == "line") & band).select("doc_id", "page", line_form("text").alias("form")).distinct()
    counts = forms.groupBy("doc_id", "form").agg(F.count("*").alias("c"))
    return counts.join(pages, "doc_id").where((F.col("n") >= 2) & (F.col("c") >= F.greatest(F.lit(2), F.floor((F.col("n") + 1) / 2)))).select("doc_id", "form", "c", "n")
