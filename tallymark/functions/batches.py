"""Slices of the batches in which texts reach Python functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SLICE_CHARS = 1 << 16
SLICE_ITEMS = 1 << 20


def text_slices(texts: pd.Series, chars: int = SLICE_CHARS) -> Iterator[pd.Series]:
    """``texts`` in consecutive slices that begin within the same ``chars`` characters.

    A function that works slice by slice holds what it makes of a slice and not
    of a whole batch. A longer text is a slice of its own; none is cut.
    """
    if len(texts):
        before = texts.str.len().fillna(0).cumsum().shift(fill_value=0)
        for _, part in texts.groupby((before // chars).to_numpy(), sort=False):
            yield part


def array_slices(texts: pa.Array, size: int = SLICE_CHARS) -> Iterator[pa.Array]:
    """As :func:`text_slices` for texts in Arrow and bytes; nothing is copied."""
    yield from _slices(texts, pc.binary_length(texts), size)


def list_slices(lists: pa.Array, size: int = SLICE_ITEMS) -> Iterator[pa.Array]:
    """As :func:`array_slices` for lists and their items."""
    yield from _slices(lists, pc.list_value_length(lists), size)


def _slices(rows: pa.Array, sizes: pa.Array, size: int) -> Iterator[pa.Array]:
    sizes = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype("int64")
    before = np.cumsum(sizes) - sizes
    starts = [0, *(np.flatnonzero(np.diff(before // size)) + 1), len(rows)]
    for start, stop in zip(starts, starts[1:]):
        if stop > start:
            yield rows.slice(start, stop - start)
