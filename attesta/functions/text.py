"""Text functions on columns: markup to plain text, tokens, numbers, grams and small formats."""

from __future__ import annotations

import difflib
import html
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

from attesta.functions import patterns as P


@pandas_udf(StringType())
def decode_entities(text: pd.Series) -> pd.Series:
    """Named and numbered entities as characters; only texts with an ampersand need it."""
    return text.map(html.unescape, na_action="ignore")


@pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition of a text."""
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings; null if either is."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, even where it stands inside a lambda."""
    return F.get(F.transform(F.array(value), use), 0)


def strip_tags(text: Column | str) -> Column:
    """Tags become spaces; a bare ``<=`` is no tag."""
    return F.regexp_replace(_col(text), P.TAG, " ")


def plain(text: Column | str, decode: bool = True) -> Column:
    """Markup to plain text. ``decode=False`` stays in the JVM where no text has entities."""
    bare = strip_tags(text)
    bare = decode_entities(bare) if decode else bare
    return F.replace(F.replace(bare, F.lit("**"), F.lit(" ")), F.lit("\t"), F.lit(" "))


def fold(text: Column, compose: bool = True) -> Column:
    """Lower case with straight quotes and plain hyphens."""
    text = F.lower(nfkc(text) if compose else text)
    return F.translate(text, "’‘–—", "''--")


def tokens(text: Column | str, exact: bool = True) -> Column:
    """Lower-case words and numbers in order, thousands separators removed.

    ``exact`` decodes entities and composes characters (two Arrow functions);
    without it everything stays in generated code.
    """
    found = F.regexp_extract_all(fold(plain(text, exact), exact), F.lit(P.TOKEN), F.lit(0))
    return F.transform(found, lambda t: F.when(F.contains(t, F.lit(",")), F.regexp_replace(t, P.THOUSANDS, "")).otherwise(t))


def numbers(toks: Column) -> Column:
    """Tokens that are numbers."""
    return F.filter(toks, lambda t: t.rlike(r"^\d"))


def grams(toks: Column | str, n: int = 3) -> Column:
    """All runs of ``n`` tokens, as strings; none if there are fewer tokens."""

    def runs(t: Column) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.concat_ws(" ", *(F.get(t, i + (k - 1)) for k in range(n))))
        return F.when(F.size(t) >= n, found).otherwise(F.array().cast("array<string>"))

    return let(_col(toks), runs)


def slug(text: Column | str, empty: str = "file") -> Column:
    """Letters and digits joined by single underscores."""
    s = F.trim(F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(empty))


def image_tokens(width: Column | str, height: Column | str) -> Column:
    """Cost of an image scaled to 1568 pixels at its longer edge, 750 pixels a token."""
    w, h = _col(width).cast("double"), _col(height).cast("double")
    s = F.least(F.lit(1.0), F.lit(1568.0) / F.greatest(w, h))
    return (w * s * h * s / 750).cast("int")


def escape_inline(text: Column | str) -> Column:
    """Source text as inline HTML, with bold and italic runs."""
    t = F.replace(F.replace(F.replace(_col(text), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    t = F.regexp_replace(t, r"\*\*(.+?)\*\*", "<b>$1</b>")
    return F.regexp_replace(t, r"(?<![\w*])\*(?!\s)(.+?)(?<!\s)\*(?![\w*])", "<em>$1</em>")


def parse_number(text: Column | str) -> Column:
    """A number without its commas; null if it is none."""
    return F.replace(_col(text).cast("string"), F.lit(","), F.lit("")).try_cast("double")


def close_to(value: Column, expected: Column, tolerance: float = P.CALC_TOLERANCE) -> Column:
    """Whether two numbers agree within a relative tolerance; false if either is null."""
    return F.coalesce(F.abs(value - expected) <= F.greatest(F.lit(tolerance) * F.abs(expected), F.lit(P.CALC_FLOOR)), F.lit(False))


def display_number(value: Column | str) -> Column:
    """Whole numbers grouped; from 1000 two decimals; else four significant digits."""
    v = _col(value).cast("double")
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    digits = F.greatest(F.lit(0), 3 - F.floor(F.log10(F.abs(v)))).cast("int")
    factor = F.pow(F.lit(10.0), digits)
    short = F.round(v * factor) / factor
    text = F.regexp_replace(F.format_string("%.10f", short), r"\.?0+$", "")
    return F.when(v.isNull(), "").when(whole, F.format_number(v, 0)).when(F.abs(v) >= 1000, F.format_number(v, 2)).otherwise(text)


def first_number(text: Column | str) -> Column:
    """The first signed number in a text; a minus sign may be U+2212."""
    found = F.nullif(F.regexp_extract(_col(text), P.SIGNED_NUMBER, 0), F.lit(""))
    return parse_number(F.replace(found, F.lit("\u2212"), F.lit("-")))


def line_key(toks: Column) -> Column:
    """First twelve tokens of an item's first line."""
    return F.array_join(F.slice(toks, 1, 12), " ")


def prefix_functions(formula: Column | str) -> Column:
    """Dotted spreadsheet functions with the prefix that files need."""
    f = _col(formula)
    return F.when(f.startswith("="), F.regexp_replace(f, P.DOTTED_FUNCTION, "_xlfn.$1(")).otherwise(f)


def unlabelled(text: Column | str) -> Column:
    """A source line without option labels: all inline ones from three on, else a leading one."""
    t = _col(text)
    inline = F.size(F.regexp_extract_all(t, F.lit(P.INLINE_LABEL), F.lit(0))) >= 3
    return F.when(inline, F.regexp_replace(t, P.INLINE_LABEL, " ")).otherwise(F.regexp_replace(t, P.OPTION_LABEL, ""))


def marks_total(text: Column | str) -> Column:
    """Sum of all printed marks; null without any."""
    found = F.regexp_extract_all(_col(text), F.lit(P.MARKS), F.lit(1))
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda a, x: a + x.cast("double")))


def math_state(text: Column | str) -> Column:
    """What is wrong with a text's maths delimiters; null if nothing.

    Folds over the delimiters with a state of depth one: what is open, and the
    first fault met.
    """
    t = _col(text)
    marks = F.regexp_extract_all(t, F.lit(P.MATH_TOKEN), F.lit(0))
    start = F.struct(F.lit("").alias("open"), F.lit(None).cast("string").alias("fault"))

    def step(s: Column, m: Column) -> Column:
        opens = m.isin("\\(", "\\[")
        wanted = F.when(s["open"] == "\\(", "\\)").when(s["open"] == "\\[", "\\]")
        fault = (
            F.when(opens & (s["open"] != ""), F.lit("nested"))
            .when(~opens & (s["open"] == ""), F.lit("without opener"))
            .when(~opens & (m != wanted), F.lit("closed by another"))
        )
        return F.struct(F.when(opens, m).otherwise(F.lit("")).alias("open"), F.coalesce(s["fault"], fault).alias("fault"))

    end = F.aggregate(marks, start, step)
    verdict = F.coalesce(end["fault"], F.when(end["open"] != "", F.lit("never closed")))
    return F.when(F.size(marks) > 0, verdict).when(t.rlike(P.DOLLAR_MATH), F.lit("dollars"))


def tick_step(lo: Column, hi: Column, n: int = 5) -> Column:
    """Smallest of 1, 2, 2.5, 5, 10 times a power of ten that is an n-th of the range or more."""
    span = F.when(hi > lo, hi - lo).otherwise(F.lit(1.0)) / n
    base = F.pow(F.lit(10.0), F.floor(F.log10(span)))
    steps = F.transform(F.array(*(F.lit(x) for x in (1.0, 2.0, 2.5, 5.0, 10.0))), lambda m: m * base)
    return F.coalesce(F.array_min(F.filter(steps, lambda s: s >= span)), span)


def content_hash(*columns: str) -> Column:
    """SHA-1 of the columns as JSON in the order given."""
    return F.sha1(F.to_json(F.struct(*columns)))


def suffix_kind(path: Column | str) -> Column:
    """What kind of file a path names: pdf, image, office, sheet, csv or text."""
    ext = F.lower(F.regexp_extract(_col(path), r"\.([^./\\]+)$", 1))
    return (
        F.when(ext == "pdf", "pdf").when(ext.isin(*P.IMAGE_SUFFIXES), "image").when(ext.isin(*P.OFFICE_SUFFIXES), "office")
        .when(ext.isin(*P.SHEET_SUFFIXES), "sheet").when(ext == "csv", "csv").otherwise("text")
    )


def document_role(name: Column, head: Column, question_lines: Column) -> Column:
    """Solution, reading or paper, by the name first, then the first lines, then question-like lines."""
    return (
        F.when(name.rlike(P.SOLUTION_WORDS), "solution").when(name.rlike(P.READING_WORDS), "reading")
        .when(F.lower(head).rlike(P.SOLUTION_HEAD), "solution").when(question_lines >= 2, "paper").otherwise("reading")
    )
