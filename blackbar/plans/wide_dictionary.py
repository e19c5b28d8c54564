"""Matching against a dictionary too large for the driver's memory.

What is found depends on a text alone, so texts are matched once each, under their digest, and
the rows take the result from there: null and repeated keys need no care.

Every text position offers a short byte window to a hash join with the dictionary on the
first bytes of the patterns. What the join finds are occurrences; overlapping ones are
settled in order of their end, inside each run of overlapping occurrences only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blackbar.plans.skew import salted_join

# Positions expanded per intermediate row, so a long text is never one huge array.
_POSITIONS = 4096
# Dictionaries up to this many bytes are broadcast; the size is read before deciding.
_BROADCAST_BYTES = 64 * 1024 * 1024
_ROW_OVERHEAD = 64
_SALTS = 16


def candidates(df: DataFrame, keys: list[str], col: str, vault: DataFrame) -> DataFrame:
    """All occurrences of live patterns: ``keys, pattern_id, start_byte, end_byte``."""
    from blackbar.operators.vault import live_patterns

    live = live_patterns(vault)
    shape = vault.agg(
        F.min("pattern_bytes").alias("shortest"),
        F.max("pattern_bytes").alias("longest"),
        F.sum(F.col("pattern_bytes") + _ROW_OVERHEAD).alias("size"),
    ).first()
    shortest, longest, size = (shape[c] or 0 for c in ("shortest", "longest", "size"))

    entries = live.select(
        F.col("pattern_id"),
        F.encode("pattern", "UTF-8").alias("_bytes"),
        F.col("pattern_bytes").alias("_n"),
    ).withColumn("_gram", F.substring("_bytes", 1, shortest))

    text = F.encode(F.col(col), "UTF-8")
    blocks = df.select(*keys, text.alias("_text")).where(
        F.octet_length("_text") >= max(shortest, 1)
    )
    block = F.transform(
        F.sequence(F.lit(0), F.octet_length("_text") - 1, F.lit(_POSITIONS)),
        lambda at: F.struct(
            at.cast("bigint").alias("_at"),
            F.col("_text").substr(at + 1, F.lit(_POSITIONS + longest - 1)).alias("_slice"),
        ),
    )
    in_block = F.transform(
        F.sequence(F.lit(0), F.least(F.octet_length("_slice"), F.lit(_POSITIONS)) - 1),
        lambda i: F.struct(
            (F.col("_at") + i).alias("start_byte"),
            F.col("_slice").substr(i + 1, F.lit(longest)).alias("_window"),
        ),
    )
    windows = (
        blocks.select(*keys, F.inline(block))
        .select(*keys, F.inline(in_block))
        .withColumn("_gram", F.substring("_window", 1, shortest))
    )
    if size <= _BROADCAST_BYTES:
        joined = windows.join(F.broadcast(entries), "_gram")
    else:
        # A frequent gram would fill one task: spread its positions over salts.
        salted = windows.withColumn(
            "_salt", F.pmod(F.xxhash64(*keys, "start_byte"), F.lit(_SALTS)).cast("int")
        )
        repeated = entries.withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
        )
        joined = salted.join(repeated, ["_gram", "_salt"])
    return joined.where(F.col("_window").substr(F.lit(1), F.col("_n")) == F.col("_bytes")).select(
        *keys,
        "pattern_id",
        "start_byte",
        (F.col("start_byte") + F.col("_n")).alias("end_byte"),
    )


_TEXT = ["_digest"]


def _digest(col: str):
    return F.unhex(F.sha2(F.encode(F.col(col), "UTF-8"), 256))


def find_matches(df: DataFrame, keys: list[str], col: str, vault: DataFrame) -> DataFrame:
    found = _text_matches(df, col, vault)
    return df.select(*keys, _digest(col).alias("_digest")).join(found, _TEXT).drop("_digest")


def _text_matches(df: DataFrame, col: str, vault: DataFrame) -> DataFrame:
    texts = df.select(F.col(col).alias("_body"), _digest(col).alias("_digest"))
    texts = texts.where(F.col("_body").isNotNull()).dropDuplicates(_TEXT)
    return _matches(texts, _TEXT, "_body", vault)


def _matches(df: DataFrame, keys: list[str], col: str, vault: DataFrame) -> DataFrame:
    by_end = Window.partitionBy(*keys).orderBy("end_byte", "start_byte")
    reach = F.max("end_byte").over(by_end.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("start_byte") < reach, 0).otherwise(1)
    runs = candidates(df, keys, col, vault).withColumn("_opens", opens).withColumn(
        "_run", F.sum("_opens").over(by_end.rowsBetween(Window.unboundedPreceding, 0))
    )
    ordered = F.array_sort(F.collect_list(F.struct("end_byte", "start_byte", "pattern_id")))
    zero = F.struct(
        F.lit(0).cast("bigint").alias("end"),
        F.array()
        .cast("array<struct<end_byte:bigint,start_byte:bigint,pattern_id:int>>")
        .alias("taken"),
    )

    def settle(acc, m):
        return F.when(
            m["start_byte"] >= acc["end"],
            F.struct(
                m["end_byte"].alias("end"),
                F.concat(acc["taken"], F.array(m)).alias("taken"),
            ),
        ).otherwise(acc)

    taken = (
        runs.groupBy(*keys, "_run")
        .agg(ordered.alias("_found"))
        .select(*keys, F.inline(F.aggregate("_found", zero, settle, lambda a: a["taken"])))
    )
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("start_byte")) - 1
    return taken.select(
        *keys, number.alias("match_no"), "pattern_id", "start_byte", "end_byte"
    )


def _with_replacements(matches: DataFrame, vault: DataFrame) -> DataFrame:
    """Add ``replacement``; a frequent pattern's matches stay where their texts are, or are salted."""
    size = F.sum(F.coalesce(F.octet_length("replacement"), F.lit(0)) + _ROW_OVERHEAD)
    replacements = vault.select("pattern_id", "replacement")
    if (vault.agg(size).first()[0] or 0) <= _BROADCAST_BYTES:
        return matches.join(F.broadcast(replacements), "pattern_id")
    return salted_join(matches, replacements.hint("merge"), ["pattern_id"], "_digest", "inner")


def redact(df: DataFrame, col: str, vault: DataFrame, out: str) -> DataFrame:
    matches = _with_replacements(_text_matches(df, col, vault), vault)
    per_text = matches.groupBy(*_TEXT).agg(
        F.array_sort(F.collect_list(F.struct("start_byte", "end_byte", "replacement"))).alias("_m")
    )
    text = F.encode(F.col(col), "UTF-8")
    n = F.size("_m")

    def piece(i):
        # The gap before match i and the replacement of match i; the last has only a gap.
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("_m"), i - 1)["end_byte"])
        end = F.coalesce(F.get(F.col("_m"), i)["start_byte"], F.octet_length(text))
        gap = text.substr((begin + 1).cast("int"), (end - begin).cast("int"))
        return F.concat(
            gap.cast("string"), F.coalesce(F.get(F.col("_m"), i)["replacement"], F.lit(""))
        )

    rebuilt = F.array_join(F.transform(F.sequence(F.lit(0), n), piece), "")
    return (
        df.withColumn("_digest", _digest(col))
        .join(per_text, _TEXT, "left")
        .withColumn(out, F.when(F.col("_m").isNull(), F.col(col)).otherwise(rebuilt))
        .drop("_m", "_digest")
    )
