"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from attesta.session import BATCH_RECORDS, bound_batches  # noqa: F401

def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that further columns of an input cannot clash."""
    return df.select(*names)


def chunks(values: Iterable, size: int) -> Iterator[list]:
    """Lists of at most ``size`` values."""
    out: list = []
    for x in values:
        out.append(x)
        if len(out) >= size:
            yield out
            out = []
    if out:
        yield out


def signed(x: int) -> int:
    """An unsigned 64-bit number as Spark's long holds it."""
    return x - (1 << 64) if x >> 63 else x


def as_long(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's longs."""
    return np.ascontiguousarray(values, dtype=np.uint64).view(np.int64)
