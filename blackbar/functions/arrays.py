"""Helpers on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where the body names it in a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(lengths: Column, start: Column) -> Column:
    """Exclusive running sums of a short array, starting at ``start``."""
    zero = F.struct(
        start.cast("bigint").alias("at"),
        F.array().cast("array<bigint>").alias("starts"),
    )

    def step(acc, n):
        return F.struct(
            (acc["at"] + n).cast("bigint").alias("at"),
            F.concat(acc["starts"], F.array(acc["at"])).alias("starts"),
        )

    return F.aggregate(lengths, zero, step, lambda acc: acc["starts"])


def running_starts(lengths: Column) -> Column:
    """Exclusive running sums of an integer array.

    Appending to an array copies it, so long arrays are summed in blocks: the block
    totals are run first, then every block from its own start.
    """
    return let(lengths, _block_starts)


def _block_starts(lengths: Column) -> Column:
    last = F.floor((F.size(lengths) - 1) / _BLOCK)
    blocks = F.transform(
        F.sequence(F.lit(0), last.cast("int")),
        lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)),
    )

    def starts(blocks: Column) -> Column:
        totals = F.transform(
            blocks, lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, n: a + n)
        )
        return F.flatten(F.zip_with(blocks, _running(totals, F.lit(0)), _running))

    return F.when(F.size(lengths) <= _BLOCK, _running(lengths, F.lit(0))).otherwise(let(blocks, starts))
