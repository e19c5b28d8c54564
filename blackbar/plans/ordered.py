"""Ordered computations over the rows of a key, without giving a key to one task.

All of them cut the order of a key into blocks of a fixed number of order values, work
inside the blocks in parallel, combine the (few) block results and hand them back. A key
that holds a third of the table is spread over as many tasks as it has blocks.

Keys and the order column must not be null, and the order must be unique within a key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# 2**10 rows to a block, 2**10 blocks to a group of blocks.
ORDINAL_BITS = (10, 10)


def running_sum(
    rows: DataFrame,
    keys: list[str],
    order: str,
    value: Column,
    out: str,
    bits: tuple[int, int] = ORDINAL_BITS,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the earlier rows of the key (exclusive).

    ``order`` is an integer column. ``bits`` says how many of its low bits make up a block
    and how many of the next ones a group of blocks.
    """
    low, high = bits
    blocked = rows.withColumn("_value", value.cast("bigint")).withColumn(
        "_block", F.shiftright(order, low)
    )
    blocks = (
        blocked.groupBy(*keys, "_block")
        .agg(F.sum("_value").alias("_total"))
        .withColumn("_group", F.shiftright("_block", high))
    )
    groups = blocks.groupBy(*keys, "_group").agg(F.sum("_total").alias("_total"))

    def before(column: str, partition: list[str], by: str) -> Column:
        earlier = Window.partitionBy(*partition).orderBy(by).rowsBetween(
            Window.unboundedPreceding, -1
        )
        return F.coalesce(F.sum(column).over(earlier), F.lit(0))

    groups = groups.select(
        *keys, "_group", before("_total", keys, "_group").alias("_group_start")
    )
    blocks = (
        blocks.withColumn("_in_group", before("_total", [*keys, "_group"], "_block"))
        .join(groups, [*keys, "_group"])
        .select(
            *keys, "_block", (F.col("_group_start") + F.col("_in_group")).alias("_block_start")
        )
    )
    return (
        blocked.withColumn("_in_block", before("_value", [*keys, "_block"], order))
        .join(blocks, [*keys, "_block"])
        .withColumn(out, F.col("_block_start") + F.col("_in_block"))
        .drop("_value", "_block", "_in_block", "_block_start")
    )


def ordered_scan(
    rows: DataFrame,
    keys: list[str],
    order: str,
    value: Column,
    type_ddl: str,
    identity: Column,
    combine: Callable[[Column, Column], Column],
    out: str,
    carry: list[str] | None = None,
    last: str | None = None,
    bits: tuple[int, ...] = (10, 12),
) -> DataFrame:
    """Exclusive prefix combination of ``value`` along ``order`` for any associative ``combine``.

    Returns ``keys, order, carry..., out`` where ``out`` combines the values of all
    earlier rows of the key (``identity`` for the first), and with ``last`` a column that
    says whether the row is the last of its key. ``value`` should be narrow: blocks of
    2**bits rows are sorted in memory. Used with "last n bytes" and with small transition
    functions, for which no window function exists.
    """
    carry = carry or []
    plain = F.struct(F.lit(True).alias("_"))
    carried = F.struct(*carry) if carry else plain
    carried_type = f"struct<{_struct_ddl(rows, carry)}>"

    def scan(level: DataFrame, c_type: str, remaining: tuple[int, ...]) -> DataFrame:
        # level: keys, o (bigint), c (carried columns), v (value)
        packed = F.array_sort(F.collect_list(F.struct("o", "v", "c")))
        if remaining:
            grouped = level.groupBy(*keys, F.shiftright("o", remaining[0]).alias("g")).agg(
                packed.alias("steps")
            )
            totals = grouped.select(
                *keys,
                F.col("g").alias("o"),
                F.aggregate("steps", identity, lambda a, s: combine(a, s["v"])).alias("v"),
                plain.alias("c"),
            )
            starts = scan(totals, "struct<_:boolean>", remaining[1:]).select(
                *keys,
                F.col("o").alias("g"),
                F.col("p").alias("start"),
                F.col("l").alias("last_group"),
            )
            grouped = grouped.join(starts, [*keys, "g"])
        else:
            grouped = (
                level.groupBy(*keys)
                .agg(packed.alias("steps"))
                .withColumn("start", identity)
                .withColumn("last_group", F.lit(True))
            )
        done_type = f"array<struct<o:bigint,c:{c_type},p:{type_ddl},l:boolean>>"
        zero = F.struct(F.col("start").alias("at"), F.array().cast(done_type).alias("done"))

        def step(acc, s):
            is_last = F.col("last_group") & (F.size(acc["done"]) + 1 == F.size("steps"))
            row = F.struct(
                s["o"].alias("o"), s["c"].alias("c"), acc["at"].alias("p"), is_last.alias("l")
            )
            return F.struct(
                combine(acc["at"], s["v"]).alias("at"),
                F.concat(acc["done"], F.array(row)).alias("done"),
            )

        done = F.aggregate("steps", zero, step, lambda acc: acc["done"])
        return grouped.select(*keys, F.inline(done))

    base = rows.select(
        *keys, F.col(order).cast("bigint").alias("o"), value.alias("v"), carried.alias("c")
    )
    return scan(base, carried_type, bits).select(
        *keys,
        F.col("o").alias(order),
        *[F.col(f"c.{name}").alias(name) for name in carry],
        F.col("p").alias(out),
        *([F.col("l").alias(last)] if last else []),
    )


def _struct_ddl(rows: DataFrame, columns: list[str]) -> str:
    if not columns:
        return "_:boolean"
    return ",".join(f"`{c}`:{rows.schema[c].dataType.simpleString()}" for c in columns)


def recut(
    rows: DataFrame,
    keys: list[str],
    order: str,
    data: str,
    piece_length: int,
    piece_no: str = "piece_no",
) -> DataFrame:
    """Join the ordered values of a key and cut the result on a fixed grid.

    ``data`` is BINARY (lengths in bytes) or STRING (lengths in characters). Every piece
    but the last of a key has exactly ``piece_length``, so a group never holds more than
    that, however the input was cut and however long the whole is. Keys with no content
    yield no row.
    """
    length = F.length(data)
    placed = running_sum(
        rows.select(*keys, order, data).where(length > 0), keys, order, length, "_start"
    )
    size = F.lit(piece_length).cast("bigint")
    first = F.call_function("div", F.col("_start"), size)
    last = F.call_function("div", F.col("_start") + length - 1, size)

    def part(piece: Column) -> Column:
        begin = F.greatest(piece * size - F.col("_start"), F.lit(0))
        end = F.least((piece + 1) * size - F.col("_start"), length)
        return F.struct(
            piece.alias(piece_no),
            F.col(data).substr((begin + 1).cast("int"), (end - begin).cast("int")).alias("_part"),
        )

    return (
        placed.select(*keys, "_start", F.inline(F.transform(F.sequence(first, last), part)))
        .groupBy(*keys, piece_no)
        .agg(F.expr("listagg(_part) WITHIN GROUP (ORDER BY _start)").alias(data))
    )
