"""Fidelity of digitised papers: every rule as findings over items, source lines and solutions.

Items are one table (:data:`ITEM_SCHEMA`); sources are line records of
:func:`attesta.sources.markup.source_lines`. Each rule explodes what it needs
and joins on the document, so papers are checked side by side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from attesta.functions import patterns as P, text as T
from attesta.operators import containment, coverage, multiset, validate
from attesta.session import materialise, scratch_dir
from attesta.sources import markup

MEDIA = "array<struct<t:string,title:string,x:string,caption:string,head:array<string>,rows:array<array<string>>,src_id:string>>"
PART = f"struct<label:string,head:boolean,q:string,o:array<string>,choices:array<string>,a:int,num:array<double>,official:string,e:string,media:{MEDIA}>"
ITEM_SCHEMA = (
    f"paper string, source string, n int, name string, head boolean, sub boolean, q string, o array<string>, a int, num array<double>, media {MEDIA}, parts array<{PART}>, "
    f"lo int, hi int, official string, emedia {MEDIA}, e_source string, e_lo int, e_hi int, e string, checks array<string>"
)
_NONE = "array<string>"


def _list(column: Column | str, kind: str = _NONE) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.array().cast(kind))


def has_options() -> Column:
    """Whether an item is a choice question."""
    return (F.size(_list("o")) > 0) & ~F.coalesce("sub", F.lit(False)) & ~F.coalesce("head", F.lit(False))


def _block(q: Column, media: Column) -> Column:
    """Texts of a block in order: stem, then of each shown block its texts, table head and rows."""
    shown = F.transform(
        _list(media, MEDIA),
        lambda b: F.concat(
            F.array_compact(F.array(b["title"], b["x"], b["caption"])),
            F.when(b["t"] == "table", F.concat(F.array(F.array_join(_list(b["head"]), " ")), F.transform(_list(b["rows"], "array<array<string>>"), lambda r: F.array_join(r, " ")))).otherwise(F.array().cast(_NONE)),
        ),
    )
    return F.concat(F.array(F.coalesce(q, F.lit(""))), F.flatten(shown))


def segments() -> Column:
    """An item's printed texts, one for each block, its parts' after its own."""
    parts = F.flatten(F.transform(_list("parts", f"array<{PART}>"), lambda p: F.concat(_block(p["q"], p["media"]), _list(p["o"]))))
    own = F.concat(_block(F.col("q"), F.col("media")), F.when(has_options(), _list("o")).otherwise(F.array().cast(_NONE)))
    return F.concat(own, parts)


def option_sets(items: DataFrame) -> DataFrame:
    """Options of items, of parts, and choices of parts: paper, source, n, place, k, text."""
    own = items.where(has_options()).select("paper", "source", "n", F.lit("").alias("place"), F.posexplode("o").alias("k", "text"))
    parts = items.select("paper", "source", "n", F.posexplode(_list("parts", f"array<{PART}>")).alias("i", "p"))
    label = F.coalesce(F.nullif(F.col("p.label"), F.lit("")), F.concat(F.lit("part "), F.col("i") + 1))
    inner = parts.select("paper", "source", "n", label.alias("place"), F.posexplode(_list("p.o")).alias("k", "text"))
    more = parts.select("paper", "source", "n", F.concat(label, F.lit(" choices")).alias("place"), F.posexplode(_list("p.choices")).alias("k", "text"))
    return own.unionByName(inner).unionByName(more)


def all_media(items: DataFrame) -> DataFrame:
    """Shown blocks of items and their parts, one a row."""
    shown = F.concat(_list("media", MEDIA), F.flatten(F.transform(_list("parts", f"array<{PART}>"), lambda p: _list(p["media"], MEDIA))))
    return items.select("paper", "source", "n", F.explode(shown).alias("b"))


def source_tokens(lines: DataFrame, exact: bool = True) -> DataFrame:
    """All tokens of each source in order, across its lines: what items are compared with."""
    rows = lines.where(F.col("kind").isin("text", "table_row", "ignored", "key")).select(F.col("doc_id").alias("source"), "no", T.tokens("text", exact).alias("t"))
    return rows.groupBy("source").agg(_in_order("t", "no").alias("tokens"))


def _in_order(tokens: str, *order: str) -> Column:
    """All tokens of a group's rows in order; they have no spaces, and travel as one string a row."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.array_join(tokens, " ").alias("t"))))
    whole = F.array_join(F.filter(F.transform(rows, lambda x: x["t"]), lambda t: t != ""), " ")
    return F.filter(F.split(whole, " "), lambda t: t != "")


def _finding(rows: DataFrame, rule: str, detail: Column, severity: str = "error") -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "paper", "n", detail.cast("string").alias("detail"))


def _labelled() -> Column:
    """Whether an item's place in the source has option labels."""
    return has_options() | F.exists(_list("parts", f"array<{PART}>"), lambda p: F.size(_list(p["o"])) > 0)


def _spans(items: DataFrame, lines: DataFrame, lo: str, hi: str, source: str, labels: bool, exact: bool) -> DataFrame:
    """Tokens and numbers of each item's source span, option labels left out of choice questions."""
    spans = items.where(F.col(lo).isNotNull()).select("paper", "n", F.col(source).alias("doc_id"), F.col(lo).alias("lo"), F.col(hi).alias("hi"), _labelled().alias("mcq"))
    rows = markup.line_span(lines, spans)
    text = F.when(F.col("mcq"), T.unlabelled("text")).otherwise(F.col("text")) if labels else F.col("text")
    if not labels:
        rows = rows.where(~F.col("text").rlike(P.SOLUTION_NOTE))
    found = rows.select("paper", "n", "no", T.tokens(text, exact).alias("t")).groupBy("paper", "n").agg(_in_order("t", "no").alias("span"))
    return found


def _numbers(items: DataFrame, lines: DataFrame, exact: bool) -> DataFrame:
    """Numbers that items and their places in the source have unequally often.

    Numbers are found before lines meet items, so that no texts are shuffled;
    texts that can have none aren't made tokens.
    """
    may = lambda text: text.rlike(r"[\d&]|[^\x00-\x7f]" if exact else r"\d")
    of = lambda text, bare: F.when(may(text), T.numbers(T.tokens(bare, exact))).otherwise(F.array().cast(_NONE))
    text, own = F.col("text"), F.array_join(segments(), " ")
    spans = items.where("lo is not null").select("paper", "n", F.col("source").alias("doc_id"), "lo", "hi", _labelled().alias("mcq"), of(own, own).alias("own"))
    rows = markup.line_span(lines.select("doc_id", "no", "kind", of(text, text).alias("plain"), of(text, T.unlabelled(text)).alias("bare")), spans)
    rows = rows.select("doc_id", "paper", "n", F.when(F.col("mcq"), F.col("bare")).otherwise(F.col("plain")).alias("span"), "own").where("size(span) > 0 or size(own) > 0")
    pairs = rows.groupBy("doc_id", "paper", "n").agg(F.flatten(F.collect_list("span")).alias("span"), F.first("own").alias("own"))
    return _number_findings(pairs, "numbers differ")


def _number_findings(pairs: DataFrame, rule: str) -> DataFrame:
    """Numbers that ``span`` and ``own``, arrays of numbers, have unequally often."""
    diff = multiset.array_difference(pairs, ["paper", "n"], "span", "own")
    return _finding(diff, rule, F.concat_ws(" ", F.when(F.col("missing") > 0, F.concat(F.lit("missing "), "value")), F.when(F.col("extra") > 0, F.concat(F.lit("not in source "), "value"))))


def _within(scores: DataFrame, least: DataFrame | None, threshold: float) -> DataFrame:
    """Scores with ``least``: what the paper asks for itself, else the threshold."""
    if least is None:
        return scores.withColumn("least", F.lit(threshold))
    return scores.join(least.select("paper", F.col("verbatim_min").alias("own_least")), "paper", "left").withColumn("least", F.coalesce("own_least", F.lit(threshold))).drop("own_least")


def check_papers(items: DataFrame, lines: DataFrame, threshold: float = P.PRECISION_ERROR, least: DataFrame | None = None, solutions: DataFrame | None = None, exact: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(findings, scores, reasons)`` of all papers; each a table keyed by paper and n.

    ``least`` (paper, verbatim_min) overrides the threshold for a paper;
    ``solutions`` (paper, source, place) are the solution sheets of papers in
    order: an official solution whose sheet isn't among them is compared with
    the first. ``exact=False`` stays in the JVM where texts have neither
    entities nor characters that are composed.
    """
    source = source_tokens(lines, exact)
    vocabulary = source.select("source", F.explode(F.array_distinct("tokens")).alias("word"))
    seg = items.select("paper", "source", "n", F.explode(segments()).alias("text"))
    own = items.select("paper", "source", "n", T.tokens(F.array_join(segments(), " "), exact).alias("own"))
    scores = _within(containment.segment_precision(seg, source, ["source", "paper", "n"], "source", exact=exact), least, threshold)
    low = F.col("precision") < F.col("least")
    found = [_finding(scores.where(low), "precision", F.col("precision"))]

    options = option_sets(items)
    by_option = _within(containment.segment_precision(options, source, ["source", "paper", "n", "place", "k"], "source", exact=exact), least, threshold)
    found.append(_finding(by_option.where(low), "option", F.concat_ws(" ", F.nullif("place", F.lit("")), F.lit("option"), F.col("k") + 1)))

    tables = all_media(items).where("b.t = 'table'")
    cells = tables.select("paper", "source", "n", F.explode(F.concat(_list("b.head"), F.flatten(_list("b.rows", "array<array<string>>")))).alias("text"))
    words = cells.select("paper", "source", "n", F.explode(T.tokens("text", exact)).alias("word"))
    found.append(_finding(words.join(vocabulary, ["source", "word"], "left_anti"), "table cell", F.col("word")))

    span = _spans(items, lines, "lo", "hi", "source", True, exact).join(own, ["paper", "n"])
    found.append(_finding(coverage.uncovered_runs(span.select("paper", "n", "span", "own"), ["paper", "n"], "span", "own"), "missing from the item", F.col("context")))
    found.append(_numbers(items, lines, exact))
    found.append(_objects(items, lines))

    parts = items.select("paper", "source", "n", F.posexplode(_list("parts", f"array<{PART}>")).alias("k", "p"))
    keys = parts.where(F.coalesce("p.official", F.lit("")) != "").select("paper", "source", "n", "k", F.col("p.official").alias("text"))
    key_scores = _within(containment.segment_precision(keys, source, ["source", "paper", "n", "k"], "source", exact=exact), least, threshold)
    found.append(_finding(key_scores.where(low), "printed key", F.col("k") + 1))
    found += _official(items, lines, source, threshold, least, solutions, exact)
    found.append(_whole_papers(items, lines, own, exact))
    found.append(_unconfirmed(items))
    found.append(_answers(items, parts))
    reasons = _reasons(items, lines).unionByName(_close(scores))
    return reduce(DataFrame.unionByName, found), scores.select("paper", "n", "precision"), reasons


def _objects(items: DataFrame, lines: DataFrame) -> DataFrame:
    """Tables and figures of a span that its item doesn't show; drawn blocks count for figures."""
    spans = items.where("lo is not null").select(F.col("source").alias("doc_id"), F.struct("paper", "n").alias("item"), "lo", "hi")
    there = markup.objects_in_span(lines, spans).select("item.*", "tables", "figures")
    shown = F.transform(F.concat(_list("media", MEDIA), F.flatten(F.transform(_list("parts", f"array<{PART}>"), lambda p: _list(p["media"], MEDIA)))), lambda b: F.struct(b["t"].alias("t"), b["src_id"].alias("s")))
    official = F.transform(_list("emedia", MEDIA), lambda b: b["src_id"])
    rows = there.join(items.select("paper", "n", shown.alias("m"), official.alias("f")), ["paper", "n"])
    ids = F.concat(F.transform("m", lambda b: b["s"]), "f")
    drawn = F.size(F.filter("m", lambda b: b["t"].isin(*P.DRAWN_TYPES)))
    lost = F.array_except("figures", ids)
    tables = rows.select("paper", "n", F.explode(F.array_except("tables", ids)).alias("t"))
    figures = rows.where(F.size(lost) > drawn - F.size(F.array_intersect("figures", ids))).select("paper", "n", F.array_join(lost, " ").alias("t"))
    return _finding(tables, "table not shown", F.col("t")).unionByName(_finding(figures, "figure not shown", F.col("t")))


def _official(items: DataFrame, lines: DataFrame, source: DataFrame, threshold: float, least: DataFrame | None, solutions: DataFrame | None, exact: bool) -> list[DataFrame]:
    """Official solutions against the source they come from; a printed leading number is no text of theirs.

    The source is the sheet that is named, else the paper itself where none or the paper is
    named, else the paper's first sheet.
    """
    rows = items.where(F.coalesce("official", F.lit("")) != "")
    if solutions is not None:
        sheets = solutions.groupBy("paper").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "source"))), lambda x: x["source"]).alias("sheets"))
        named = F.when(F.array_contains(_list("sheets"), F.col("e_source")), F.col("e_source"))
        itself = F.when(F.col("e_source").isNull() | (F.col("e_source") == F.col("source")), F.col("source"))
        rows = rows.join(sheets, "paper", "left").withColumn("e_source", F.coalesce(named, itself, F.get(_list("sheets"), 0), "e_source"))
    rows = rows.withColumn("e_source", F.coalesce("e_source", "source"))
    known = rows.join(source.select(F.col("source").alias("e_source")), "e_source", "left_semi")
    lost = rows.join(source.select(F.col("source").alias("e_source")), "e_source", "left_anti")
    own = F.filter(_list("emedia", MEDIA), lambda b: b["src_id"].isNotNull() & (b["t"] == "table"))
    printed = F.concat(F.array("official"), F.flatten(F.transform(own, lambda b: F.concat(F.array(F.array_join(_list(b["head"]), " ")), F.transform(_list(b["rows"], "array<array<string>>"), lambda r: F.array_join(r, " "))))))
    seg = known.select("paper", "n", F.col("e_source").alias("source"), F.explode(printed).alias("text"))
    low = _within(containment.segment_precision(seg, source, ["source", "paper", "n"], "source", exact=exact), least, threshold).where(F.col("precision") < F.col("least"))
    span = _spans(known, lines, "e_lo", "e_hi", "e_source", False, exact)
    lead = F.get("span", 0).rlike(r"^\d")
    span = span.withColumn("span", F.when(F.coalesce(lead, F.lit(False)), F.slice("span", 2, F.size("span"))).otherwise(F.col("span")))
    pairs = span.join(known.select("paper", "n", T.tokens(F.array_join(printed, " "), exact).alias("own")), ["paper", "n"])
    return [
        _finding(lost, "no solution source", F.col("e_source")), _finding(low, "official precision", F.col("precision")),
        _finding(coverage.uncovered_runs(pairs, ["paper", "n"], "span", "own"), "missing from the official solution", F.col("context")), _number_findings(pairs.select("paper", "n", T.numbers(F.col("span")).alias("span"), T.numbers(F.col("own")).alias("own")), "official numbers differ")]


def _whole_papers(items: DataFrame, lines: DataFrame, own: DataFrame, exact: bool) -> DataFrame:
    """Runs of three words or more of a paper's source that none of its items holds."""
    printed = items.where(F.coalesce("e_source", "source") == F.col("source")).select("paper", "source", "n", T.tokens(F.coalesce("official", F.lit("")), exact).alias("t"))
    both = own.select("paper", "source", "n", F.lit(0).alias("k"), F.col("own").alias("t")).unionByName(printed.withColumn("k", F.lit(1)))
    covered = both.groupBy("paper", "source").agg(_in_order("t", "n", "k").alias("item"))
    choice = items.where(has_options() & F.col("lo").isNotNull()).groupBy("source").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")).withColumnRenamed("source", "doc_id")
    rows = markup.content(lines).where(~F.col("text").rlike(P.SOLUTION_NOTE)).select("doc_id", "no", "text").join(choice, "doc_id", "left")
    text = F.when(F.exists("spans", lambda x: F.col("no").between(x["lo"], x["hi"])), T.unlabelled("text")).otherwise(F.col("text"))
    whole = rows.select(F.col("doc_id").alias("source"), "no", T.tokens(text, exact).alias("t")).groupBy("source").agg(_in_order("t", "no").alias("text"))
    runs = coverage.uncovered_runs(covered.join(whole, "source"), ["paper"], "text", "item", least=3, before=2, after=2)
    return _finding(runs.withColumn("n", F.lit(None).cast("int")), "in no item", F.col("context"))


#: Explanations shorter than this are worth a look.
SHORT_EXPLANATION = 60


def _answers(items: DataFrame, parts: DataFrame) -> DataFrame:
    """Answers that are not set or point nowhere, options that repeat, and solutions that are not explained or too shortly."""
    def rules(rows: DataFrame, o: Column, a: Column, num: Column, e: Column, sub: Column) -> DataFrame:
        free = sub | num.isNotNull()
        e = F.coalesce(e, F.lit(""))
        fault = lambda c, rule, severity="error": F.when(c, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity")))
        faults = F.array_compact(F.array(
            fault(e == "", "explanation missing"), fault((e != "") & (F.length(e) < SHORT_EXPLANATION), "explanation short", "warning"),
            fault(~free & (F.size(o) < 2), "fewer than two options"), fault(F.size(F.array_distinct(o)) < F.size(o), "options repeat", "warning"),
            fault(~free & (F.size(o) >= 2) & a.isNull(), "answer not set"), fault(~free & (F.size(o) >= 2) & ~a.between(0, F.size(o) - 1), "answer out of range")))
        return rows.select("paper", "n", F.explode(faults).alias("f"))

    plain = items.where(~F.coalesce("head", F.lit(False)) & (F.size(_list("parts", f"array<{PART}>")) == 0))
    own = rules(plain, _list("o"), F.col("a"), F.col("num"), F.col("e"), F.coalesce("sub", F.lit(False)))
    inner = parts.where(~F.coalesce("p.head", F.lit(False))).join(items.select("paper", "n", F.col("e").alias("whole")), ["paper", "n"])
    offered = F.concat(_list("p.o"), _list("p.choices"))
    more = rules(inner, offered, F.col("p.a"), F.col("p.num"), F.coalesce(F.nullif("p.e", F.lit("")), "whole"), F.size(offered) == 0)
    both = own.unionByName(more)
    return both.select("f.rule", "f.severity", "paper", "n", F.lit(None).cast("string").alias("detail"))


def _unconfirmed(items: DataFrame) -> DataFrame:
    return _finding(items.select("paper", "n", F.explode(_list("checks")).alias("c")), "unconfirmed", F.col("c"))


def _close(scores: DataFrame) -> DataFrame:
    """Items that nearly match: a reason to look at them."""
    return scores.where((F.col("precision") >= F.col("least")) & (F.col("precision") < P.PRECISION_RISK)).select("paper", "n", F.lit("text match").alias("reason"))


def _reasons(items: DataFrame, lines: DataFrame) -> DataFrame:
    """Why to look at an item though nothing is wrong with it: what its place in the source holds, and how it is made."""
    spans = items.where("lo is not null").select(F.col("source").alias("doc_id"), F.struct("paper", "n").alias("item"), "lo", "hi")
    held = markup.objects_met(lines, spans).select("item.*", F.array_compact(F.array(F.when(F.size("tables") > 0, "table"), F.when(F.size("figures") > 0, "figure"))).alias("why"))
    parts = F.size(_list("parts", f"array<{PART}>"))
    why = F.array_compact(F.array(
        F.when(F.col("lo").isNull() & ~F.coalesce("head", F.lit(False)), "hand-made item (no source span)"), F.when(F.col("o").isNotNull() & ~F.coalesce("sub", F.lit(False)), "MCQ"),
        F.when(parts > 0, F.concat(parts, F.lit(" sub-parts")))))
    return items.select("paper", "n", F.explode(why).alias("reason")).unionByName(held.select("paper", "n", F.explode("why").alias("reason")))


def riskiest(findings: DataFrame, reasons: DataFrame, k: int = 8) -> DataFrame:
    """The items to compare with their print first."""
    return _first(_risk(findings, reasons), k)


def _risk(findings: DataFrame, reasons: DataFrame) -> DataFrame:
    return validate.risk_scores(findings.where("n is not null and severity = 'error'"), reasons, ["paper", "n"], P.RISK_WEIGHTS, match_weight=P.TEXT_MATCH_WEIGHT)


def _first(scored: DataFrame, k: int) -> DataFrame:
    return validate.first_rows(scored, k, F.col("score").desc(), F.col("paper"), F.col("n"))


def review_first(items: DataFrame, lines: DataFrame, k: int = 8, threshold: float = P.PRECISION_ERROR, least: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """:func:`riskiest` by numbers that differ, guesses that nobody has confirmed, and all reasons.

    A text match adds one weight to a score. So an item can be among the first
    only if it is within that weight of the k-th without it, and triples are
    counted for such items alone; ties are among them. The result is that of
    all items.
    """
    root, weight = scratch_dir(items.sparkSession), P.TEXT_MATCH_WEIGHT
    base = materialise(_risk(_numbers(items, lines, exact).unionByName(_unconfirmed(items)), _reasons(items, lines)), f"{root}/base")
    n, last = base.orderBy(F.col("score").desc()).limit(k).agg(F.count("*"), F.min("score")).first()
    rows = items
    if n == k and last > weight + 1e-9:  # else items without any other reason may be among them
        rows = items.join(materialise(base.where(F.col("score") >= last - weight - 1e-9).select("paper", "n"), f"{root}/near"), ["paper", "n"], "left_semi")
    seg = materialise(rows.select("paper", "source", "n", F.explode(segments()).alias("text")), f"{root}/segments")
    known = source_tokens(lines.join(seg.select(F.col("source").alias("doc_id")).distinct(), "doc_id", "left_semi"), exact)
    close = _close(_within(containment.segment_precision(seg, known, ["source", "paper", "n"], "source", exact=exact), least, threshold)).select("paper", "n", F.lit(weight).alias("more"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return _first(base.join(close, ["paper", "n"], "full").select("paper", "n", zero("errors").alias("errors"), (zero("score") + zero("more")).alias("score")), k)


def expand_refs(questions: DataFrame, items: DataFrame) -> DataFrame:
    """Bank questions with the item they refer to and the last heading before it; ``item_q`` is null where there is none."""
    order = Window.partitionBy("paper").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    head = F.last(F.when(F.coalesce("head", F.lit(False)), F.col("q")), ignorenulls=True).over(order)
    known = items.select("paper", "n", "name", F.col("q").alias("item_q"), head.alias("head_q"), F.coalesce("head", F.lit(False)).alias("h")).where("not h").drop("h")
    return questions.join(known, (questions["ref_paper"] == known["paper"]) & (questions["ref_n"] == known["n"]), "left").drop("paper", "n")


def expand_examples(examples: DataFrame, items: DataFrame) -> DataFrame:
    """Examples with the item or part they show: ``part`` is a place from one on, or a label (the first that fits).

    ``passage`` is the nearest passage before the part.
    """
    rows = examples.join(items.select("paper", "n", F.col("q").alias("item_q"), _list("parts", f"array<{PART}>").alias("parts")), ["paper", "n"], "left")
    number = F.col("part").try_cast("int")
    by_label = F.array_position(F.transform("parts", lambda p: F.trim(F.coalesce(p["label"], F.lit("")))), F.trim("part"))
    place = F.when(number.between(1, F.size("parts")), number).otherwise(F.nullif(by_label, F.lit(0)).cast("int"))
    at = rows.withColumn("place", place)
    before = F.filter(F.slice("parts", 1, F.greatest(F.coalesce(F.col("place"), F.lit(1)) - 1, F.lit(0))), lambda p: F.coalesce(p["head"], F.lit(False)))
    return at.select(*examples.columns, "item_q", "place", F.get("parts", F.col("place") - 1)["q"].alias("part_q"), F.get(before, F.size(before) - 1)["q"].alias("passage"))


def paper_counts(items: DataFrame) -> DataFrame:
    """Items, parts, choice, numeric and written answers of each paper, headings left out."""
    rows = items.where(~F.coalesce("head", F.lit(False)))
    inner = F.filter(_list("parts", f"array<{PART}>"), lambda p: ~F.coalesce(p["head"], F.lit(False)))
    count = lambda f: F.size(F.filter(inner, f))
    per = rows.select(
        "paper", F.size(inner).alias("p"), (F.size(_list("parts", f"array<{PART}>")) > 0).cast("int").alias("w"),
        (has_options().cast("int") + count(lambda p: F.size(_list(p["o"])) + F.size(_list(p["choices"])) > 0)).alias("m"),
        (F.col("num").isNotNull().cast("int") + count(lambda p: p["num"].isNotNull())).alias("d"))
    return per.groupBy("paper").agg(F.count("*").alias("items"), F.sum("p").alias("parts"), F.sum("m").alias("mcq"), F.sum("d").alias("numeric"), (F.count("*") + F.sum("p") - F.sum("w") - F.sum("m") - F.sum("d")).alias("written"))


PRIVATE = ("source", "lo", "hi", "e_source", "e_lo", "e_hi", "checks", "src_id")


def without_private(df: DataFrame, names: tuple[str, ...] = PRIVATE) -> DataFrame:
    """What may be published: no private fields at any depth, none that starts with an underscore."""
    private = lambda name: name.startswith("_") or name in names

    def open_(value: Column, kind: DataType) -> Column:
        if isinstance(kind, ArrayType):
            return F.transform(value, lambda x: open_(x, kind.elementType))
        if isinstance(kind, StructType):
            kept = [open_(value[f.name], f.dataType).alias(f.name) for f in kind.fields if not private(f.name)]
            return F.when(value.isNotNull(), F.struct(*kept))
        return value

    return df.select(*(open_(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields if not private(f.name)))


def in_sections(df: DataFrame, column: str, chosen: list[str]) -> DataFrame:
    """Rows of the chosen sections."""
    return df.where(F.col(column).isin(*chosen))
