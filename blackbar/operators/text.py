"""Finding and redacting dictionary patterns in a text column.

Every operator here is a plain projection or filter by one regular expression (no shuffle, no
Python), with the same rows for a dictionary of any size. plans/wide_dictionary.py has a join
plan for a vault that does not fit in the driver's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blackbar.functions.arrays import let, running_starts
from blackbar.functions.patterns import (
    TOKEN,
    Dictionary,
    as_dictionary,
    quote_replacement,
)

Vault = DataFrame | Dictionary


def _gaps(text: Column, regex: str) -> Column:
    return F.split(text, regex, -1)


def _hits(text: Column, regex: str) -> Column:
    return F.regexp_extract_all(text, F.lit(regex), F.lit(0))


def matches_any(text: Column, d: Dictionary) -> Column:
    return F.lit(False) if d.regex is None else F.rlike(text, F.lit(d.regex))


def match_count(text: Column, d: Dictionary) -> Column:
    return F.lit(0) if d.regex is None else F.regexp_count(text, F.lit(d.regex))


def redacted(text: Column, d: Dictionary, token: str = TOKEN) -> Column:
    """Every match replaced by one token."""
    if d.regex is None:
        return text
    return F.regexp_replace(text, d.regex, quote_replacement(token))


def replaced(text: Column, d: Dictionary, attribute: str = "replacement") -> Column:
    """Every match replaced by its own pattern's replacement."""
    if d.regex is None:
        return text
    distinct = {getattr(e, attribute) for e in d.live}
    if len(distinct) == 1:
        return F.regexp_replace(text, d.regex, quote_replacement(distinct.pop()))
    by_pattern = d.lookup(attribute)
    pieces = F.zip_with(
        _gaps(text, d.regex),
        _hits(text, d.regex),
        lambda gap, hit: F.concat(gap, F.coalesce(by_pattern[hit], F.lit(""))),
    )
    return F.array_join(pieces, "")


def filter_matching(
    df: DataFrame, col: str, vault: Vault, negate: bool = False, keys: list[str] | None = None
) -> DataFrame:
    """Rows whose text holds a pattern, or with ``negate`` those it leaves unchanged.

    A null text holds none. ``keys`` are no longer needed and not used.
    """
    hit = F.coalesce(matches_any(F.col(col), as_dictionary(vault)), F.lit(False))
    return df.where(~hit if negate else hit)


def redact_constant(
    df: DataFrame, col: str, vault: Vault, token: str = TOKEN, out: str | None = None
) -> DataFrame:
    return df.withColumn(out or col, redacted(F.col(col), as_dictionary(vault), token))


def redact_text(
    df: DataFrame, col: str, vault: Vault, keys: list[str] | None = None, out: str | None = None
) -> DataFrame:
    """Replace each match by its pattern's replacement (``keys`` are no longer needed)."""
    return df.withColumn(out or col, replaced(F.col(col), as_dictionary(vault)))


def redact_json_text(
    df: DataFrame, col: str, vault: Vault, out: str | None = None
) -> DataFrame:
    """As ``redact_text`` with JSON-escaped replacements, for text that is raw JSON."""
    d = as_dictionary(vault)
    return df.withColumn(out or col, replaced(F.col(col), d, "escaped_replacement"))


def _pieces(text: Column, d: Dictionary, token: str | None) -> Column:
    """Gaps and hits of a text in order, as structs with byte offsets."""
    values = F.flatten(
        F.zip_with(
            _gaps(text, d.regex),
            _hits(text, d.regex),
            lambda gap, hit: F.array(
                F.struct(gap.alias("source"), F.lit(False).alias("hit")),
                F.struct(hit.alias("source"), hit.isNotNull().alias("hit")),
            ),
        )
    )
    ids = d.lookup("pattern_id")
    written = d.lookup("replacement")

    def piece(v, start):
        source = F.coalesce(v["source"], F.lit(""))
        replacement = F.lit(token) if token is not None else written[source]
        return F.struct(
            F.when(v["hit"], "Replacement").otherwise("Input").alias("kind"),
            F.when(v["hit"], replacement).otherwise(source).alias("value"),
            start.alias("start_byte"),
            (start + F.octet_length(source)).alias("end_byte"),
            F.when(v["hit"], ids[source]).alias("pattern_id"),
        )

    def placed(values: Column) -> Column:
        starts = running_starts(
            F.transform(values, lambda v: F.coalesce(F.octet_length(v["source"]), F.lit(0)))
        )
        return F.zip_with(values, starts, piece)

    return F.filter(let(values, placed), lambda p: p["end_byte"] > p["start_byte"])


_MATCH_COLUMNS = ("match_no", "pattern_id", "start_byte", "end_byte")


def find_matches(df: DataFrame, keys: list[str], col: str, vault: Vault) -> DataFrame:
    """All matches: ``keys, match_no, pattern_id, start_byte, end_byte``."""
    d = as_dictionary(vault)
    if d.regex is None:
        return df.where(F.lit(False)).select(
            *keys,
            F.lit(0).alias("match_no"),
            F.lit(0).alias("pattern_id"),
            F.lit(0).cast("bigint").alias("start_byte"),
            F.lit(0).cast("bigint").alias("end_byte"),
        )
    ids = d.lookup("pattern_id")

    def placed(parts: Column) -> Column:
        hits = parts["hits"]
        # A match starts after all gaps up to its own and all matches before it.
        gap_starts = running_starts(F.transform(parts["gaps"], F.octet_length))
        hit_starts = running_starts(F.transform(hits, F.octet_length))
        return F.transform(
            F.arrays_zip(
                hits.alias("hit"),
                F.slice(gap_starts, 2, F.size(hits)).alias("gap_end"),
                hit_starts.alias("before"),
            ),
            lambda m: F.struct(
                ids[m["hit"]].alias("pattern_id"),
                (m["gap_end"] + m["before"]).alias("start_byte"),
                (m["gap_end"] + m["before"] + F.octet_length(m["hit"])).alias("end_byte"),
            ),
        )

    parts = F.struct(
        _gaps(F.col(col), d.regex).alias("gaps"), _hits(F.col(col), d.regex).alias("hits")
    )
    found = let(parts, placed)
    with_hit = df.where(matches_any(F.col(col), d))
    return with_hit.select(*keys, F.posexplode(found).alias("match_no", "m")).select(
        *keys, "match_no", "m.*"
    )


def segment_text(
    df: DataFrame, keys: list[str], col: str, vault: Vault, token: str | None = TOKEN
) -> DataFrame:
    """Ordered Input / Replacement pieces; empty inputs are left out.

    ``token=None`` writes each pattern's own replacement.
    """
    d = as_dictionary(vault)
    if d.regex is None:
        whole = F.array(
            F.struct(
                F.lit("Input").alias("kind"),
                F.col(col).alias("value"),
                F.lit(0).cast("bigint").alias("start_byte"),
                F.octet_length(col).cast("bigint").alias("end_byte"),
                F.lit(None).cast("int").alias("pattern_id"),
            )
        )
        pieces = F.filter(whole, lambda p: p["end_byte"] > 0)
    else:
        pieces = _pieces(F.col(col), d, token)
    return df.select(*keys, F.posexplode(pieces).alias("segment_no", "s")).select(
        *keys, "segment_no", "s.*"
    )


def redaction_counters(df: DataFrame, col: str, vault: Vault, by: list[str]) -> DataFrame:
    """Per group: texts, texts with a match (what the counter counts) and matches."""
    n = match_count(F.col(col), as_dictionary(vault))
    return (
        df.select(*by, n.alias("_n"))
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("texts"),
            F.count_if(F.col("_n") > 0).alias("redactions_total"),
            F.sum(F.coalesce("_n", F.lit(0))).alias("matches"),
        )
    )


def pattern_counters(df: DataFrame, col: str, vault: Vault, by: list[str]) -> DataFrame:
    """Matches per group and pattern id (the label is the id, never the pattern)."""
    d = as_dictionary(vault)
    if d.regex is None:
        return df.where(F.lit(False)).select(
            *by, F.lit(0).alias("pattern_id"), F.lit(0).cast("bigint").alias("matches")
        )
    return (
        df.select(*by, F.explode(_hits(F.col(col), d.regex)).alias("_hit"))
        .select(*by, d.lookup("pattern_id")[F.col("_hit")].alias("pattern_id"))
        .groupBy(*by, "pattern_id")
        .agg(F.count(F.lit(1)).alias("matches"))
    )


def reconcile_bytes(
    raw: DataFrame, redacted_rows: DataFrame, segments: DataFrame, keys: list[str],
    raw_col: str, redacted_col: str, vault: Vault,
) -> DataFrame:
    """Per key: output bytes must equal input - matched + replacements, and no Input piece
    may still hold a pattern. All three sides are summed before they are joined.
    """
    d = as_dictionary(vault)
    hit = F.col("kind") == "Replacement"
    taken = F.col("end_byte") - F.col("start_byte")
    bytes_in = raw.groupBy(*keys).agg(F.sum(F.octet_length(raw_col)).alias("bytes_in"))
    bytes_out = redacted_rows.groupBy(*keys).agg(
        F.sum(F.octet_length(redacted_col)).alias("bytes_out")
    )
    moved = segments.groupBy(*keys).agg(
        F.sum(F.when(hit, taken).otherwise(0)).alias("bytes_matched"),
        F.sum(F.when(hit, F.octet_length("value")).otherwise(0)).alias("bytes_replacement"),
        F.count_if(~hit & matches_any(F.col("value"), d)).alias("pieces_with_pattern"),
    )
    joined = bytes_in.join(bytes_out, keys, "full").join(moved, keys, "full")
    columns = [
        "bytes_in", "bytes_out", "bytes_matched", "bytes_replacement", "pieces_with_pattern"
    ]
    filled = joined.select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in columns])
    return filled.withColumn(
        "reconciled",
        (
            F.col("bytes_out")
            == F.col("bytes_in") - F.col("bytes_matched") + F.col("bytes_replacement")
        )
        & (F.col("pieces_with_pattern") == 0),
    )
