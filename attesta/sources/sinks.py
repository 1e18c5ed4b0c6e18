"""Sinks: write once, upsert by key, keep what people wrote, and a gate before writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from attesta.operators.validate import gate
from attesta.session import materialise, scratch_dir


def append_new(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key isn't there yet: what is there is never overwritten."""
    return new.join(existing.select(key).distinct(), key, "left_anti")


def write_once(new: DataFrame, existing: DataFrame, key: str, header: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, skipped)``: what stands after a run that overwrites nothing.

    A row that is there with the same header keeps its edits; one with another
    header belongs to another file, and the new row is skipped.
    """
    there = existing.select(key, F.col(header).alias("_header"))
    skipped = new.join(there, key).where(~F.col(header).eqNullSafe(F.col("_header"))).select(*new.columns)
    return existing.unionByName(append_new(new, existing, key)), skipped


def raw_copies(new: DataFrame, existing: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Untouched copies after a run: of documents with a page that isn't typed, written the first time only; ``pages``: key, mode."""
    read = pages.where("mode <> 'typed'").select(key).distinct()
    return existing.unionByName(append_new(new.join(read, key, "left_semi"), existing, key))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """New rows replace old ones of their key; of several new rows of a key the last by ``order`` counts, where it is given."""
    if order is not None:
        new = new.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("_r = 1").drop("_r")
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def merge_fields(new: DataFrame, old: DataFrame, key: str, owned: list[str], order: str | None = None, prefer_new: tuple[str, ...] = ()) -> DataFrame:
    """Every new row; columns in ``owned`` come from it, the others from the old row of its key if that has them.

    Of several old rows of a key the last by ``order`` counts. Columns in
    ``prefer_new`` take the old value only where the new one is null.
    """
    if order is not None:
        latest = Window.partitionBy(key).orderBy(F.col(order).desc())
        old = old.withColumn("_r", F.row_number().over(latest)).where("_r = 1").drop("_r")
    kept = [c for c in old.columns if c not in owned and c != key and c in new.columns]
    extra = [c for c in old.columns if c not in owned and c != key and c not in new.columns and c != order]
    side = old.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_old_{c}") for c in kept + extra))
    joined = new.join(side, new[key] == side["_key"], "left")

    def column(c: str):
        if c in kept:
            return (F.coalesce(F.col(c), F.col(f"_old_{c}")) if c in prefer_new else F.coalesce(F.col(f"_old_{c}"), F.col(c))).alias(c)
        return F.col(c)

    return joined.select(*(column(c) for c in new.columns), *(F.col(f"_old_{c}").alias(c) for c in extra))


def write_checked(df: DataFrame, findings: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """Write JSON only if no finding is an error."""
    gate(findings)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).json(path)


def memo(rows: DataFrame, cache: DataFrame | None, content: list[str], compute) -> DataFrame:
    """Values of rows by content hash; only rows whose hash the cache lacks are computed."""
    from attesta.functions.text import content_hash

    hashed = rows.withColumn("hash", content_hash(*content))
    if cache is None:
        return materialise(compute(hashed), f"{scratch_dir(rows.sparkSession)}/memo")
    known = cache.dropDuplicates(["hash"])
    return hashed.join(known, "hash").unionByName(compute(hashed.join(known.select("hash"), "hash", "left_anti")))
