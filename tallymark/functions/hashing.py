"""Row encodings, hash limbs and digest rendering as column expressions."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions.batches import array_slices

JSON_OPTIONS = {"ignoreNullFields": "false"}
LIMBS = [f"l{i}" for i in range(8)]


def canonical_json(cols: Sequence[str | Column]) -> Column:
    """Compact JSON of the columns in the given order; nulls stay visible."""
    return F.to_json(F.struct(*cols), JSON_OPTIONS)


def python_json_value(value):
    """Plain Python value of one Arrow-to-pandas cell."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, dict):
        return {k: python_json_value(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [python_json_value(v) for v in value]
    return None if value is None or value is pd.NA else value


def python_json(cols: Sequence[str], indent: int | None = None) -> Column:
    """``json.dumps`` of a row as a dict: spaced separators, ASCII escapes.

    Compatibility form for digests made outside Spark. Each column crosses to
    Python as its own JSON so that integers keep their type beside nulls.
    """

    @F.arrow_udf(T.StringType())
    def render(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield from rendered_json(rows, indent)

    return render(canonical_json(list(cols)))


def rendered_json(rows: pa.Array, indent: int | None = None) -> Iterator[pa.Array]:
    """JSON texts as ``json.dumps`` writes them; a few rows at a time leave Arrow and return to it."""
    for part in array_slices(rows):
        yield pa.array([json.dumps(json.loads(text), indent=indent, default=str) for text in part.to_pylist()], pa.string())


def row_element(cols: Sequence[str], idx: str | Column | None, form: str = "canonical") -> Column:
    """The text hashed for one row: its encoding and, if given, its position."""
    if form == "canonical":
        body, mark = canonical_json(list(cols)), "#"
    elif form == "python":
        body, mark = python_json(cols), ""
    else:
        raise ValueError(f"unknown row form {form!r}")
    if idx is None:
        return body
    position = F.col(idx) if isinstance(idx, str) else idx
    return F.concat(body, F.lit(mark), position.cast("string"))


def hash_words(hex_digest: Column) -> list[Column]:
    """A 64-digit hex digest as five 48-bit words and a last 16-bit one."""
    spans = [(1 + 12 * i, 12) for i in range(5)] + [(61, 4)]
    return [F.conv(F.substring(hex_digest, start, size), 16, 10).cast("bigint") for start, size in spans]


def word_halves(words: Sequence[Column]) -> list[Column]:
    """The sixteen 16-bit digits of :func:`hash_words`, most significant first."""
    digits = []
    for word in words[:5]:
        digits += [F.shiftright(word, 32),
                   F.shiftright(word, 16).bitwiseAND(F.lit(65535)),
                   word.bitwiseAND(F.lit(65535))]
    return digits + [words[5]]


def carry_chain(sums: Sequence[Column], bits: int) -> tuple[Column, list[Column]]:
    """Normalise digit sums (most significant first) to digits below ``2**bits``.

    Returns what overflows the top digit (negative for a negative total) and
    the digits.
    """
    carry, digits = F.lit(0).cast("bigint"), []
    for total in reversed(list(sums)):
        here = total + carry
        digits.append(here.bitwiseAND(F.lit((1 << bits) - 1)))
        carry = F.shiftright(here, bits)
    return carry, digits[::-1]


def one_line_base64(data: Column) -> Column:
    """Base64 without the line breaks Spark puts in."""
    return F.translate(F.base64(data), "\r\n", "")


def hex_to_base64(hex_digest: Column) -> Column:
    """Base64 of a hex number with leading zero bytes trimmed."""
    digits = F.regexp_replace(hex_digest, "^0+", "")
    even = F.when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits)
    return one_line_base64(F.unhex(even))


def bytes_to_base64(hex_digest: Column) -> Column:
    """Base64 of a fixed-size hex digest; leading zeros are part of it."""
    return one_line_base64(F.unhex(hex_digest))
