"""Which words and triples of one list of tokens another has, for whole Arrow batches at once; exact, without a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Tokens of all lists, and the place of each one's list."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return pc.list_flatten(lists), np.repeat(np.arange(len(sizes)), sizes)


def units(one: pa.Array, own: np.ndarray, two: pa.Array, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of both sides' tokens and of the triples that begin at them; -1 where a list ends first."""
    codes = pa.concat_arrays([one, two]).dictionary_encode()
    token, k = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(codes.dictionary), 1)
    lists = np.concatenate([own, other + (own[-1] + 1 if len(own) else 0)])
    gram = np.full(len(token), -1, np.int64)
    at = np.nonzero(lists[:-2] == lists[2:])[0] if len(token) > 2 else np.zeros(0, np.int64)
    _, pair = np.unique(token[at] * k + token[at + 1], return_inverse=True)
    _, gram[at] = np.unique(pair * k + token[at + 2], return_inverse=True)
    return token[: len(one)], gram[: len(one)], token[len(one) :], gram[len(one) :]


def found(unit: np.ndarray, row: np.ndarray, known: np.ndarray, known_row: np.ndarray) -> np.ndarray:
    """Whether a unit is among those known in its row."""
    most = max(unit.max(initial=0), known.max(initial=0)) + 1
    return np.isin(row * most + unit, known_row * most + known)
