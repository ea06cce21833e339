"""Scalar formulas over columns: schedules, accounting, rounding to blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def down_to(n: Column, block: int) -> Column:
    return (F.floor(n / block) * block).cast("long")


def up_to(n: Column, block: int) -> Column:
    return (F.floor((n + (block - 1)) / block) * block).cast("long")


def id_dtype(vocab: Column) -> Column:
    """The narrowest unsigned type that holds ids below vocab; an error beyond 32 bits or below 1."""
    return (
        F.when(vocab <= 0, F.raise_error(F.lit("a vocabulary needs an id")))
        .when(vocab <= 1 << 16, F.lit("uint16"))
        .when(vocab <= 1 << 32, F.lit("uint32"))
        .otherwise(F.raise_error(F.lit("ids beyond 32 bits")))
    )


def utility(count: Column, n_bytes: Column) -> Column:
    return count * (1 + F.log2(F.greatest(F.lit(1), n_bytes - 1)))


def lr_stable_then_down(step: Column, max_steps: int, warmup: int, down_ratio: float, high: float, low: float) -> Column:
    """Linear up, constant, linear down over the last part; steps count from 1."""
    down = round(down_ratio * max_steps)
    start = max_steps - down
    left = (F.lit(max_steps) - step) / F.lit(float(down))
    return F.when(step < warmup, F.lit(high) * step / warmup).when(step <= start, F.lit(high)).otherwise(F.lit(low) + (high - low) * left)


def lr_cosine(step: Column, max_steps: int, warmup: int, high: float, low: float, *, from_zero: bool = False) -> Column:
    """Linear up, then half a cosine down. from_zero counts steps from 0 and holds low at max_steps already."""
    up = F.lit(high) * ((step + 1) if from_zero else step) / warmup
    part = (step - warmup) / F.lit(float(max_steps - warmup))
    over = (step >= max_steps) if from_zero else (step > max_steps)
    return F.when(step < warmup, up).when(over, F.lit(low)).otherwise(low + 0.5 * (1 + F.cos(F.lit(math.pi) * part)) * (high - low))


def bits_per_byte(loss: Column, bytes_per_token: Column) -> Column:
    return loss / (F.lit(math.log(2)) * bytes_per_token)


def soft_cap(x: Column, cap: float = 30.0) -> Column:
    return cap * F.tanh(x / cap)


def rounded(x: Column, digits: int) -> Column:
    """round() that keeps the sign of a negative value which becomes zero, as C's does."""
    near = F.round(x, digits)
    return F.when((near == 0) & (x < 0), F.lit(-0.0)).otherwise(near)
