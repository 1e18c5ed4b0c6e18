"""Validation rules as DataFrame transformations into one findings table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from attesta.functions.text import close_to

FINDING = ["rule", "severity", "subject", "detail"]


def finding(rows: DataFrame, rule: str, subject: Column, detail: Column, severity: str = "error") -> DataFrame:
    """Rows as findings of one rule."""
    return rows.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once, and how often; nulls count as one key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key isn't null and has no parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def required(df: DataFrame, columns: list[str], subject: Column, rule: str = "required") -> DataFrame:
    """A finding for each column that is null, or empty text."""
    return reduce(DataFrame.unionByName, [finding(df.where(F.col(c).isNull() | (F.col(c).cast("string") == "")), rule, subject, F.lit(c)) for c in columns])


def violations(df: DataFrame, rules: dict[str, Column], subject: Column) -> DataFrame:
    """A finding for each rule (a condition that must hold) that a row breaks; null breaks it.

    All rules are tried in one pass over the rows.
    """
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return df.select(F.explode(broken).alias("rule"), F.lit("error").alias("severity"), subject.cast("string").alias("subject"), F.lit(None).cast("string").alias("detail"))


def coverage(units: DataFrame, unit_key: str, rows: DataFrame, key: str, least: int) -> DataFrame:
    """Rows for each unit, zero filled, with a status: none, few or enough."""
    counts = rows.groupBy(F.col(key).alias(unit_key)).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return units.select(unit_key).distinct().join(counts, unit_key, "left").select(
        unit_key, n.alias("n"), F.when(n == 0, "none").when(n < least, "few").otherwise("enough").alias("status"))


def mix(df: DataFrame, column: str) -> DataFrame:
    """Counts of each value and its share of all rows."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.select(column, "n", (F.col("n") / F.lit(df.count())).alias("share"))


def disagreements(df: DataFrame, value: str, expected: str, tolerance: float, percent: bool = True) -> DataFrame:
    """Rows whose value, as it is or times a hundred, isn't within tolerance of what is expected."""
    v, e = F.col(value), F.col(expected)
    ok = close_to(v, e, tolerance) | (close_to(v * 100, e, tolerance) if percent else F.lit(False))
    return df.where(~ok)


def answer_checks(calcs: DataFrame) -> DataFrame:
    """Verdict of each computed value: proven, disputed, mismatch, or nothing to check.

    ``calcs``: id, value, tol, expect, num, option_number, official
    (array of numbers), dispute. The first of expect, num and option that is
    there decides; else any official number may agree.
    """
    expected = F.coalesce("expect", "num", "option_number")
    tol = F.coalesce("tol", F.lit(0.005))
    near = lambda e: F.coalesce((F.abs(F.col("value") - e) <= F.greatest(tol * F.abs(e), F.lit(1e-9))) | (F.abs(F.col("value") * 100 - e) <= F.greatest(tol * F.abs(e), F.lit(1e-9))), F.lit(False))
    verdict = (
        F.when(F.col("value").isNull(), "no value")
        .when(expected.isNotNull(), F.when(near(expected), "proven").otherwise("mismatch"))
        .when(F.size(F.coalesce("official", F.array().cast("array<double>"))) > 0, F.when(F.exists("official", near), "proven").when(F.col("dispute").isNotNull(), "disputed").otherwise("mismatch"))
        .otherwise("nothing to check")
    )
    return calcs.select("id", "value", expected.alias("expected"), verdict.alias("verdict"))


def working_checks(calcs: DataFrame) -> DataFrame:
    """``(id, row, rule, severity)``: faults of workings and verdicts on each of their answer rows.

    ``calcs``: id, labels and ``widths`` (cells) of the rows, ``values`` (text of what
    each row gives), ``answer`` (labels or numbers of rows; null is the last), tol,
    expect and num (arrays), option_number, official (array) and dispute.
    """
    none = lambda kind: F.array().cast(f"array<{kind}>")
    n = F.size("labels")
    rows = calcs.withColumn("wanted", F.when(F.col("answer").isNull(), F.array(n.cast("string"))).otherwise(F.col("answer")))
    number = lambda x: x.try_cast("int")
    at = F.transform("wanted", lambda x: F.when(number(x).between(1, n), number(x)).otherwise(F.nullif(F.array_position("labels", x), F.lit(0)).cast("int")))
    rows = rows.withColumn("at", at).withColumn("found", F.array_compact("at"))
    expected = F.coalesce("expect", "num", F.when(F.col("option_number").isNotNull(), F.array("option_number")))
    rows = rows.withColumn("expected", expected).withColumn("even", F.col("expected").isNull() | (F.size("expected") == F.size("found")))
    said = lambda some, row, rule, severity="error": some.select("id", row.cast("int").alias("row"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))
    empty = rows.where(n == 0)
    rows = rows.where(n > 0)
    shape = rows.select("id", F.posexplode("widths").alias("i", "w")).where("w <> 2")
    lost = rows.select("id", F.posexplode("at").alias("i", "r")).where("r is null")
    errors = rows.select("id", F.posexplode("values").alias("i", "v")).where(F.col("v").startswith("#") | F.col("v").startswith("Err"))
    each = rows.where("even").select("id", "values", "expected", F.coalesce("official", none("double")).alias("official"), F.coalesce("tol", F.lit(0.005)).alias("tol"), "dispute", F.posexplode("found").alias("j", "r"))
    each = each.withColumn("v", F.replace(F.get("values", F.col("r") - 1), F.lit(","), F.lit("")).try_cast("double")).withColumn("e", F.get("expected", F.col("j")))
    unknown = each.where(F.col("v").isNull() & F.get("values", F.lit(0)).isNotNull())
    near = lambda e: (F.abs(F.col("v") - e) <= F.greatest(F.col("tol") * F.abs(e), F.lit(1e-9))) | (F.abs(F.col("v") * 100 - e) <= F.greatest(F.col("tol") * F.abs(e), F.lit(1e-9)))
    agrees = F.exists("official", lambda o: F.coalesce(near(o), F.lit(False)))
    verdict = (
        F.when(F.col("expected").isNotNull(), F.when(F.coalesce(near(F.col("e")), F.lit(False)), "proven").otherwise("differs from what is expected"))
        .when(F.size("official") > 0, F.when(agrees, "proven").when(F.col("dispute").isNotNull(), "disputed").otherwise("not in the official solution"))
        .otherwise("nothing to check against")
    )
    judged = each.where("v is not null").withColumn("verdict", verdict)
    severity = F.when(F.col("verdict") == "proven", "proven").when(F.col("verdict").isin("disputed", "nothing to check against"), "warning").otherwise("error")
    parts = [
        said(empty, F.lit(None), "no rows"), said(shape, F.col("i") + 1, "row is no label and value"), said(lost, F.col("i") + 1, "answer names no row"), said(errors, F.col("i") + 1, "row gives an error"),
        said(rows.where("not even"), F.lit(None), "answers and expected values differ in number"), said(unknown, F.col("r"), "row has no number"),
        judged.select("id", F.col("r").cast("int").alias("row"), F.col("verdict").alias("rule"), severity.alias("severity"))]
    return reduce(DataFrame.unionByName, parts)


def risk_scores(findings: DataFrame, reasons: DataFrame, key: list[str], weights: dict[str, float], default: float = 0.0, match_weight: float = 3.0) -> DataFrame:
    """Ten for each error, and each distinct reason's weight once."""
    table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    weight = F.coalesce(table[F.col("reason")], F.when(F.col("reason").startswith("text match"), match_weight).otherwise(default))
    soft = reasons.select(*key, "reason").distinct().groupBy(*key).agg(F.sum(weight).alias("soft"))
    hard = findings.groupBy(*key).agg(F.count("*").alias("errors"))
    both = soft.join(hard, key, "full")
    return both.select(*key, F.coalesce("errors", F.lit(0)).alias("errors"), (F.coalesce("errors", F.lit(0)) * weights.get("error", 10.0) + F.coalesce("soft", F.lit(0.0))).alias("score"))


def first_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """Top ``n`` in a total order (give a tie-break)."""
    return df.orderBy(*order).limit(n)


def first_errors(findings: DataFrame, n: int = 25) -> DataFrame:
    """The first errors, by rule, subject and detail."""
    return first_rows(findings.where("severity = 'error'"), n, F.col("rule"), F.col("subject"), F.col("detail"))


def gate(findings: DataFrame) -> None:
    """Raise before anything is written if any finding is an error; the first 25 are named."""
    some = first_errors(findings, 26).collect()
    if some:
        names = [f"{r['rule']}: {r['subject']} {r['detail'] or ''}".strip() for r in some[:25]]
        raise ValueError("; ".join(names) + ("; and more" if len(some) > 25 else ""))


def carry_forward(df: DataFrame, partition: list[str], order: str, flag: Column, value: Column, name: str) -> DataFrame:
    """The latest ``value`` of a flagged row before each row."""
    window = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(F.when(flag, value), ignorenulls=True).over(window))
