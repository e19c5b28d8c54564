"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def _estimated_bytes(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _broadcast_bytes(df: DataFrame) -> int:
    return df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def salted_join(
    rows: DataFrame,
    facts: DataFrame,
    keys: list[str],
    spread: str,
    how: str = "left",
    salts: int = SALTS,
) -> DataFrame:
    """Attach one-row-per-key ``facts`` to ``rows``.

    Rows of a key are split over ``salts`` shuffle keys by a hash of ``spread``; the facts,
    one narrow row per key, are repeated once per salt. When the facts turn out small at
    run time, adaptive execution replaces the shuffle by a broadcast. Spark's own estimate
    takes the repeated facts to be as small as the facts, so larger ones are kept from it.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    repeated = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    if _estimated_bytes(facts) * salts > _broadcast_bytes(facts):
        repeated = repeated.hint("merge")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


# Membership lists up to this many values become literals; longer ones stay tables.
LITERAL_VALUES = 1000


def flag_members(
    rows: DataFrame, column: str, members: DataFrame, out: str, spread: str
) -> DataFrame:
    """Add ``out``: whether ``column`` is one of the values of the one-column ``members``."""
    name = members.columns[0]
    values = members.where(F.col(name).isNotNull()).select(name).distinct()
    few = [r[0] for r in values.limit(LITERAL_VALUES + 1).collect()]
    if len(few) <= LITERAL_VALUES:
        return rows.withColumn(out, F.coalesce(F.col(column).isin(few), F.lit(False)))
    facts = values.select(F.col(name).alias(column), F.lit(True).alias(out))
    return salted_join(rows, facts, [column], spread).withColumn(
        out, F.coalesce(out, F.lit(False))
    )
