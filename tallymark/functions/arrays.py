"""Array expressions: padding, pixels, channel statistics, augmentation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.functions.text import _column

# Per-channel means and deviations of the CIFAR-10 training images.
CIFAR_MEAN = (0.4914, 0.4822, 0.4465)
CIFAR_STD = (0.2471, 0.2435, 0.2616)


def int_div(a: str | Column, b: int | Column) -> Column:
    """Whole-number quotient, exact for any BIGINT."""
    return F.call_function("div", _column(a), F.lit(b) if isinstance(b, int) else b)


def pad_left(seq: str | Column, size: int = 500, value: int = 0) -> Column:
    """The first ``size`` items, filled up with ``value`` in front."""
    seq = F.slice(_column(seq), 1, size)
    fill = F.array_repeat(F.lit(value).cast("int"), F.lit(size) - F.size(seq))
    return F.concat(fill, seq)


def pixels(text: str | Column, channels: int = 3) -> Column:
    """Blank-separated 0..255 grey values as floats in 0..1, repeated per channel."""
    parts = F.filter(F.split(_column(text), r"\s+"), lambda x: x != "")
    grey = F.transform(parts, lambda x: (x.cast("float") / F.lit(255).cast("float")).cast("float"))
    return F.flatten(F.array_repeat(grey, channels))


def normalise(values: str | Column, mean: Sequence[float] = CIFAR_MEAN, std: Sequence[float] = CIFAR_STD) -> Column:
    """``(x - mean_c) / std_c`` over a channel-major array."""
    values = _column(values)
    means, stds = F.array(*[F.lit(float(m)) for m in mean]), F.array(*[F.lit(float(s)) for s in std])
    per_channel = F.size(values) / F.lit(len(mean))

    def scaled(x, i):
        channel = F.floor(i / per_channel).cast("int")
        return (x.cast("double") - F.get(means, channel)) / F.get(stds, channel)

    return F.transform(values, scaled)


def crop_flip(values: str | Column, key: str | Column, channels: int, height: int, width: int,
              padding: int = 4, seed: int = 0) -> Column:
    """Zero-padded random crop of the same size, then a random mirror image.

    The offsets and the coin come from SHA-256 of seed and key, so a row is
    always cut the same way, here and in SQL.
    """
    values, key = _column(values), _column(key)
    span = 2 * padding + 1
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8)
    draw = F.conv(digits, 16, 10).cast("bigint") % (2 * span * span)
    top = draw % span
    left = int_div(draw, span) % span
    mirrored = int_div(draw, span * span) == 1

    def source(i):
        channel, row, col = int_div(i, height * width), int_div(i, width) % height, i % width
        col = F.when(mirrored, width - 1 - col).otherwise(col)
        y, x = row + top - padding, col + left - padding
        inside = (y >= 0) & (y < height) & (x >= 0) & (x < width)
        at = (channel * (height * width) + y * width + x).cast("int")
        return F.when(inside, F.get(values, at)).otherwise(F.lit(0.0))

    return F.transform(F.sequence(F.lit(0), F.lit(channels * height * width - 1)), source)
