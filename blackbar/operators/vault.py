"""Pattern dictionaries as tables: parse, build, and drop what can never match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blackbar.functions.patterns import TOKEN
from blackbar.plans.skew import salted_join

DEFAULT_PATTERNS = "password,secret,ssn"

# The characters with the Unicode White_Space property.
_WHITESPACE = (
    "\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
)


def trim_unicode(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{_WHITESPACE}]+|[{_WHITESPACE}]+\\z", "")


def parse_list(
    df: DataFrame, col: str, keys: list[str], default: str | None = None
) -> DataFrame:
    """Comma list -> one row per non-empty trimmed item: ``keys, item_no, item``.

    ``item_no`` counts the kept items from 0. A null list is read as ``default`` (no items
    if that is null too); a blank one has no items. Works for origin lists as well.
    """
    source = F.coalesce(F.col(col), F.lit(default)) if default is not None else F.col(col)
    items = F.filter(
        F.transform(F.split(source, ","), trim_unicode), lambda item: item != ""
    )
    return df.select(*keys, F.posexplode(items).alias("item_no", "item"))


def parse_pattern_list(df: DataFrame, col: str, keys: list[str] | None = None) -> DataFrame:
    """Comma list of patterns -> ``keys, pattern_id, pattern, replacement``."""
    keys = keys or []
    return parse_list(df, col, keys, DEFAULT_PATTERNS).select(
        *keys,
        F.col("item_no").alias("pattern_id"),
        F.col("item").alias("pattern"),
        F.lit(TOKEN).alias("replacement"),
    )


def escape_json(text: Column) -> Column:
    """The text as it stands inside a JSON string literal (without the quotes)."""
    quoted = F.to_json(F.array(text))
    return quoted.substr(F.lit(3), F.length(quoted) - 4)


def vault_table(patterns: DataFrame) -> DataFrame:
    """Complete ``pattern_id, pattern, replacement`` to a vault; an empty pattern is an error."""
    pattern = F.when(
        F.coalesce(F.length("pattern"), F.lit(0)) > 0, F.col("pattern")
    ).otherwise(F.raise_error("a pattern must not be empty"))
    return patterns.select(
        F.col("pattern_id").cast("int").alias("pattern_id"),
        pattern.alias("pattern"),
        F.coalesce("replacement", F.lit(TOKEN)).alias("replacement"),
        escape_json(F.coalesce("replacement", F.lit(TOKEN))).alias("escaped_replacement"),
        F.octet_length("pattern").alias("pattern_bytes"),
    )


def vault_from_lists(
    spark: SparkSession, patterns: list[str], replacements: list[str] | None = None
) -> DataFrame:
    """A vault from literal lists of equal length (default replacement: the token)."""
    if replacements is None:
        replacements = [TOKEN] * len(patterns)
    if len(patterns) != len(replacements):
        raise ValueError("patterns and replacements differ in length")
    if not all(patterns):
        raise ValueError("a pattern must not be empty")
    rows = [(i, p, r) for i, (p, r) in enumerate(zip(patterns, replacements))]
    return vault_table(
        spark.createDataFrame(rows, "pattern_id int, pattern string, replacement string")
    )


def max_pattern_bytes(vault: DataFrame) -> DataFrame:
    return vault.agg(F.coalesce(F.max("pattern_bytes"), F.lit(0)).alias("max_pattern_len"))


def live_patterns(vault: DataFrame) -> DataFrame:
    """Keep the patterns that can be reported: lowest id of equals, none that is shadowed.

    Pattern p is shadowed if another pattern occurs in it and ends before its end. Each
    pattern offers its substrings that end early to a hash join with the dictionary, so
    the work grows with the pattern lengths and not with the square of their number. The
    dictionary is never broadcast: estimates of its size know neither the compression of
    its files nor the substrings.
    """
    others = [c for c in vault.columns if c not in ("pattern_id", "pattern")]
    first = F.min(F.struct("pattern_id", *others)).alias("_first")
    distinct = (
        vault.groupBy("pattern").agg(first).select("pattern", "_first.*").select(*vault.columns)
    )
    n = F.length("pattern")
    early_ending = F.flatten(
        F.transform(
            F.sequence(F.lit(1), n - 1),
            lambda end: F.transform(
                F.sequence(F.lit(1), end),
                lambda start: F.col("pattern").substr(start, end - start + 1),
            ),
        )
    )
    inner = distinct.where(n > 1).select(
        "pattern_id", F.explode(F.array_distinct(early_ending)).alias("pattern")
    )
    shadowed = (
        salted_join(
            inner, distinct.select("pattern").hint("merge"), ["pattern"], "pattern_id", "left_semi"
        )
        .select("pattern_id")
        .distinct()
    )
    return distinct.join(shadowed.hint("merge"), "pattern_id", "left_anti")
