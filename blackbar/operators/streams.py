"""What became of each stream or request body: timeouts, limits, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blackbar.functions.arrays import let
from blackbar.functions.patterns import (
    TOKEN,
    as_bytes_text,
    as_dictionary,
    bytes_text,
    text_bytes,
)
from blackbar.operators.chunks import DEFAULT_CAPACITY, Vault, chunk_status, hold_limit
from blackbar.plans.gaps import first_wait, interval_micros, sessions
from blackbar.plans.ordered import running_sum
from blackbar.plans.skew import salted_join

IDLE_GAP = "15 seconds"
BODY_LIMIT = 2 * 1024 * 1024
ERROR_BODY_LIMIT = 8 * 1024


def idle_cuts(
    rows: DataFrame, key: str, ts: str, gap: str = IDLE_GAP, streams: DataFrame | None = None
) -> DataFrame:
    """Streams that waited longer than ``gap``: ``key, last_before, cut_at``.

    ``streams`` (``key, started, ended``) adds the waits for the first chunk and the end.
    """
    times = rows.select(key, F.col(ts).alias("_ts"))
    if streams is not None:
        for edge in ("started", "ended"):
            times = times.unionByName(streams.select(key, F.col(edge).alias("_ts")))
    cuts = first_wait(times, [key], "_ts", interval_micros(gap))
    return cuts.withColumn(
        "cut_at",
        F.timestamp_micros(F.unix_micros("last_before") + interval_micros(gap)),
    )


def idle_timeouts(
    rows: DataFrame, key: str, ts: str, gap: str = IDLE_GAP, streams: DataFrame | None = None
) -> DataFrame:
    """Add ``dropped``: the row comes after the first wait of its stream beyond ``gap``."""
    cuts = idle_cuts(rows, key, ts, gap, streams).select(key, "last_before")
    late = F.coalesce(F.col(ts) > F.col("last_before"), F.lit(False))
    return salted_join(rows, cuts, [key], ts).withColumn("dropped", late).drop("last_before")


def idle_sessions(rows: DataFrame, keys: list[str], ts: str, gap: str = IDLE_GAP) -> DataFrame:
    """Sessions of each key: ``first_ts, last_ts, rows``; a wait of exactly ``gap`` stays inside."""
    return sessions(rows, keys, ts, interval_micros(gap))


def declared_length(header: Column) -> Column:
    """A content-length header as a number; null if it is no unsigned 64-bit integer."""
    digits = F.regexp_extract(header, "^\\+?0*([0-9]+)\\z", 1)
    number = F.when((F.length(digits) > 0) & (F.length(digits) <= 20), digits).cast(
        "decimal(20,0)"
    )
    return F.when(number <= F.lit("18446744073709551615").cast("decimal(20,0)"), number)


def payload_limit(
    chunks: DataFrame,
    limit: int = BODY_LIMIT,
    declared: str | None = None,
    key: str = "request_id",
    seq: str = "seq",
    chunk: str = "chunk",
) -> DataFrame:
    """Add ``total_bytes`` (up to and with the chunk) and ``status``: accepted,
    declared_too_large (whole request) or body_too_large (from the crossing chunk on)."""
    size = F.coalesce(F.octet_length(chunk), F.lit(0))
    placed = running_sum(chunks, [key], seq, size, "_before")
    total = F.col("_before") + size
    status = F.when(total > limit, "body_too_large").otherwise("accepted")
    if declared:
        status = F.when(declared_length(F.col(declared)) > limit, "declared_too_large").otherwise(
            status
        )
    return placed.withColumn("total_bytes", total).withColumn("status", status).drop("_before")


def error_body_prefix(
    chunks: DataFrame,
    limit: int = ERROR_BODY_LIMIT,
    key: str = "request_id",
    seq: str = "seq",
    chunk: str = "chunk",
    ts: str | None = None,
    started: str | None = None,
    failed: str | None = None,
    vault: Vault | None = None,
    raw: bool = False,
    read_gap: str = "3 seconds",
    read_total: str = "5 seconds",
) -> DataFrame:
    """First ``limit`` bytes of each error body: ``key, body BINARY``.

    Reading stops at a ``failed`` row, and with ``ts`` and ``started`` after a wait beyond
    ``read_gap`` or beyond ``read_total`` altogether. The prefix is redacted with
    ``vault`` unless ``raw``; a match that the limit cuts is written as the token, so no part
    of it is shown. Requests without any body bytes have no row.
    """
    if not raw and vault is None:
        raise ValueError("name a vault, or ask for the raw body")
    rows = chunks
    if failed:
        first = rows.where(failed).groupBy(key).agg(F.min(seq).alias("_first_failed"))
        rows = salted_join(rows, first, [key], seq).where(
            F.col(seq) < F.coalesce("_first_failed", F.lit(2**63 - 1))
        )
    if ts and started:
        rows = rows.where(
            F.unix_micros(ts) - F.unix_micros(started) <= interval_micros(read_total)
        )
        begun = rows.groupBy(key).agg(F.min(started).alias("started")).withColumn(
            "ended", F.lit(None).cast("timestamp")
        )
        rows = idle_timeouts(rows, key, ts, read_gap, begun).where("not dropped")
    rows = rows.select(key, seq, chunk).where(F.octet_length(chunk) > 0)
    d = None if raw else as_dictionary(vault)
    # a match that begins inside the limit can be seen to its end
    reach = limit + (max(d.live_bytes - 1, 0) if d else 0)
    head = running_sum(rows, [key], seq, F.octet_length(chunk), "_before").where(
        F.col("_before") < reach
    )
    part = F.col(chunk).substr(F.lit(1), (F.lit(reach) - F.col("_before")).cast("int"))
    # Non-empty parts that together stay within the limit: a bounded group.
    bodies = (
        head.select(key, F.col(seq).alias("_seq"), part.alias("_part"))
        .groupBy(key)
        .agg(F.expr("listagg(_part) WITHIN GROUP (ORDER BY _seq)").alias("body"))
    )
    if raw:
        return bodies
    if d.byte_regex is None:
        return bodies
    text = bytes_text(F.col("body"))
    return bodies.withColumn("body", text_bytes(let(text, lambda t: _redacted_prefix(t, d.byte_regex, limit))))


def _redacted_prefix(text: Column, regex: str, limit: int) -> Column:
    """What is left of the first ``limit`` characters once every match that begins there is a token."""
    token = F.lit(as_bytes_text(TOKEN))
    parts = F.zip_with(
        F.split(text, regex, -1),
        F.regexp_extract_all(text, F.lit(regex), F.lit(0)),
        lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")),
    )
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, part):
        begin = acc["at"] + F.length(part["gap"])
        shown = F.substr(part["gap"], F.lit(1), F.greatest(F.lit(limit) - acc["at"], F.lit(0)))
        hit = F.when(part["hit"].isNotNull() & (begin < limit), token).otherwise(F.lit(""))
        return F.struct(
            (begin + F.coalesce(F.length(part["hit"]), F.lit(0))).alias("at"),
            F.concat(acc["out"], shown, hit).alias("out"),
        )

    return F.aggregate(parts, zero, step, lambda acc: acc["out"])


def stream_outcomes(
    chunks: DataFrame,
    streams: DataFrame,
    vault: Vault,
    capacity: int = DEFAULT_CAPACITY,
    gap: str = IDLE_GAP,
    key: str = "stream_id",
    seq: str = "seq",
    ts: str = "ts",
    chunk: str = "chunk",
) -> DataFrame:
    """Per stream of the log: ``key, outcome, failed_seq``; the earliest failure counts.

    ``streams`` holds ``key, started, ended, end_reason``; the outcomes read_error and
    downstream_dropped can only come from its ``end_reason``. A stream whose ``end_reason`` is
    null or unknown is ``open``. Only completed streams have a receipt.
    """
    d = as_dictionary(vault)
    cuts = idle_cuts(chunks, key, ts, gap, streams).select(key, "last_before")
    idle = (
        salted_join(chunks.select(key, seq, ts), cuts, [key], seq, how="inner")
        .where(F.col(ts) > F.col("last_before"))
        .groupBy(key)
        .agg(F.min(seq).alias("_idle_seq"))
    )
    facts = (
        chunk_status(chunks, d.max_bytes + 3, key, seq, chunk, None)
        .groupBy(key)
        .agg(
            F.min(F.when(F.col("status") == "invalid_utf8", F.col(seq))).alias("_bad_seq"),
            F.bool_or(F.col("status") == "rejected_at_end").alias("_cut_off"),
        )
    )
    joined = (
        streams.select(key, "end_reason")
        .join(cuts, key, "left")
        .join(idle, key, "left")
        .join(facts, key, "left")
    )
    if capacity < d.max_bytes + 3:
        held = hold_limit(chunks, d, capacity, key, seq, chunk)
        joined = joined.join(held.select(key, F.col("exceeded_seq").alias("_full_seq")), key, "left")
    else:
        # No more than the longest pattern and a cut-off character can ever be held.
        joined = joined.withColumn("_full_seq", F.lit(None).cast("bigint"))
    never = F.lit(2**63 - 1)
    idle_seq, bad_seq, full_seq = (
        F.coalesce(c, never) for c in ("_idle_seq", "_bad_seq", "_full_seq")
    )
    outcome = (
        F.when((idle_seq < never) & (idle_seq <= F.least(bad_seq, full_seq)), "idle_timeout")
        .when((bad_seq < never) & (bad_seq <= full_seq), "invalid_utf8")
        .when(full_seq < never, "buffer_limit")
        .when(F.col("last_before").isNotNull(), "idle_timeout")
        .when(F.col("end_reason").isin("read_error", "downstream_dropped"), F.col("end_reason"))
        .when(~F.coalesce(F.col("end_reason") == "eof", F.lit(False)), "open")
        .when(F.coalesce("_cut_off", F.lit(False)), "rejected_at_end")
        .otherwise("completed")
    )
    first = F.least(idle_seq, bad_seq, full_seq)
    return joined.select(
        key, outcome.alias("outcome"), F.when(first < never, first).alias("failed_seq")
    )
