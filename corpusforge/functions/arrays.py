"""Array functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sandwich(ids: Column, mark: int) -> Column:
    return F.concat(F.array(F.lit(mark)), ids, F.array(F.lit(mark)))


def shifted(ids: Column) -> tuple[Column, Column]:
    """(x, y): all but the last, all but the first."""
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return F.slice(ids, F.lit(1), n), F.slice(ids, F.lit(2), n)


def rows_of(ids: Column, rows: int, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice(ids, i * width + 1, F.lit(width)))


def pad_right(ids: Column, width: Column | int, value: int) -> Column:
    width = F.lit(width) if isinstance(width, int) else width
    cut = F.slice(ids, F.lit(1), width)
    return F.concat(cut, F.array_repeat(F.lit(value), (width - F.size(cut)).cast("int")))


def loss_mask(n: Column, mask_len: Column) -> Column:
    """True from max(0, min(n, mask_len - 1)) on."""
    start = F.greatest(F.lit(0), F.least(n, mask_len - 1))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: i >= start)).otherwise(F.array().cast("array<boolean>"))


def positions_of(ids: Column, value: int) -> Column:
    return F.filter(F.transform(ids, lambda x, i: F.when(x == value, i)), lambda i: i.isNotNull())


def halves(x: Column) -> tuple[Column, Column]:
    half = (F.size(x) / 2).cast("int")
    return F.slice(x, F.lit(1), half), F.slice(x, half + 1, half)


def gather(x: Column, index: Column) -> Column:
    """The items of x at the places in index, from 0; null beyond its end."""
    return F.transform(index, lambda i: F.get(x, i))


def rotate(x: Column, sin: Column, cos: Column) -> Column:
    """x * cos + (-second half, first half) * sin."""
    a, b = halves(x)
    turned = F.concat(F.transform(b, lambda v: -v), a)
    return F.zip_with(F.zip_with(x, cos, lambda p, q: p * q), F.zip_with(turned, sin, lambda p, q: p * q), lambda p, q: p + q)
