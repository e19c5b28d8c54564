"""Request-log decisions, counters, rates and concurrency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blackbar.operators.streams import BODY_LIMIT, declared_length
from blackbar.plans.gaps import interval_micros
from blackbar.plans.ordered import running_sum
from blackbar.plans.skew import flag_members

CHAT_PATH = "/v1/chat/completions"
STREAM_CAP = 1000
HANDLER_REASONS = ("body_length", "send_error", "upstream_status", "ok")


def bearer_digest(header: Column) -> Column:
    """SHA-256 of a bearer token; null for anything but ``Bearer `` and a token."""
    return F.when(
        header.startswith("Bearer "), F.sha2(header.substr(F.lit(8), F.length(header)), 256)
    )


def origin_allowlist(log: DataFrame, origins: DataFrame, spread: str = "request_id") -> DataFrame:
    """Add ``origin_allowed``: no (readable) origin, or one of the list; an empty list
    allows no origin."""
    readable = F.when(F.rlike(F.col("origin"), F.lit("^[\\x20-\\x7E\\t]*\\z")), F.col("origin"))
    flagged = flag_members(
        log.withColumn("_origin", readable),
        "_origin",
        origins.select("origin"),
        "_listed",
        spread,
    )
    return flagged.withColumn(
        "origin_allowed", F.col("_origin").isNull() | F.col("_listed")
    ).drop("_origin", "_listed")


def classify_requests(
    log: DataFrame,
    origins: DataFrame,
    key_digests: DataFrame,
    limit: int = BODY_LIMIT,
    spread: str = "request_id",
) -> DataFrame:
    """Add ``status`` and ``reason``: the first rule that applies, outermost check first."""
    rows = flag_members(
        origin_allowlist(log, origins, spread),
        "authorization_sha256",
        key_digests.select("digest"),
        "_key_ok",
        spread,
    )
    path, method = F.col("path"), F.col("method")
    upstream = F.col("upstream_status")
    probe = path.isin("/health", "/metrics")
    rules = [
        (~F.col("origin_allowed"), 403, "origin"),
        (method == "OPTIONS", 200, "preflight"),
        (declared_length(F.col("content_length")) > limit, 413, "declared_length"),
        (~probe & (path != CHAT_PATH), 404, "path"),
        (probe & method.isin("GET", "HEAD"), 200, "probe"),
        (probe, 405, "method"),
        (~F.col("_key_ok"), 401, "token"),
        (method != "POST", 405, "method"),
        (F.col("body_bytes") > limit, 413, "body_length"),
        (F.col("send_error") | upstream.isNull(), 502, "send_error"),
        (~upstream.between(200, 299), upstream, "upstream_status"),
    ]
    status, reason = F, F
    for condition, code, why in rules:
        code = code if isinstance(code, Column) else F.lit(code)
        status = status.when(condition, code)
        reason = reason.when(condition, F.lit(why))
    return (
        rows.withColumn("status", status.otherwise(F.lit(200)).cast("int"))
        .withColumn("reason", reason.otherwise(F.lit("ok")))
        .drop("_key_ok", "origin_allowed")
    )


def upstream_error_rollup(classified: DataFrame) -> DataFrame:
    """Per upstream error status: how many, and the headers of the latest one."""
    latest = F.struct("ts", "request_id")
    return (
        classified.where("reason = 'upstream_status'")
        .groupBy("status")
        .agg(
            F.count(F.lit(1)).alias("errors"),
            F.count("retry_after").alias("with_retry_after"),
            F.max_by("retry_after", latest).alias("last_retry_after"),
            F.max_by("content_type", latest).alias("last_content_type"),
        )
    )


def request_counters(classified: DataFrame) -> DataFrame:
    """Counter totals (status null) and their share per response status."""
    return (
        classified.rollup("status")
        .agg(
            F.count_if(F.col("reason").isin(*HANDLER_REASONS)).alias("proxy_requests_total"),
            F.count_if(F.col("reason") == "send_error").alias("proxy_gateway_error_total"),
            F.count_if(F.col("reason") == "upstream_status").alias("upstream_error_total"),
        )
    )


def event_rate(
    df: DataFrame,
    ts: str,
    window: str = "1 minute",
    slide: str = "5 seconds",
    by: list[str] | None = None,
) -> DataFrame:
    """Events per second over a sliding window: ``by, window_start, window_end, events, rate``.

    Counted per slide first, so a window repeats a few counts and not every event.
    """
    by = by or []
    seconds = interval_micros(window) / 1_000_000
    if interval_micros(window) % interval_micros(slide) or df.isStreaming:
        counted = df.groupBy(*by, F.window(ts, window, slide).alias("_w")).agg(
            F.count(F.lit(1)).alias("events")
        )
    else:
        slots = (
            df.groupBy(*by, F.window(ts, slide).alias("_slot"))
            .agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_ts", F.col("_slot.start"))
        )
        counted = slots.groupBy(*by, F.window("_ts", window, slide).alias("_w")).agg(
            F.sum("_n").alias("events")
        )
    return counted.select(
        *by,
        F.col("_w.start").alias("window_start"),
        F.col("_w.end").alias("window_end"),
        "events",
        (F.col("events") / seconds).alias("rate"),
    )


def active_streams(
    streams: DataFrame, window: str = "1 minute", cap: int = STREAM_CAP
) -> DataFrame:
    """Concurrent streams per window that saw a change: ``window_start, active_at_end,
    peak, over_cap``. The peak counts what was already running when the window began.

    The running level is summed per second and per hour of the log, never over all
    events in one task. At equal times ends come before starts.
    """
    starts = streams.select(F.unix_micros("started").alias("_us"), F.lit(1).alias("_up"), F.lit(0).alias("_down"))
    ends = streams.select(F.unix_micros("ended").alias("_us"), F.lit(0).alias("_up"), F.lit(1).alias("_down"))
    changes = (
        starts.unionByName(ends)
        .where(F.col("_us").isNotNull())
        .groupBy("_us")
        .agg(F.sum("_up").alias("_up"), F.sum("_down").alias("_down"))
    )
    level = running_sum(
        changes, [], "_us", F.col("_up") - F.col("_down"), "_before", bits=(20, 12)
    )
    after = F.col("_before") - F.col("_down") + F.col("_up")
    return (
        level.withColumn("_after", after)
        .groupBy(F.window(F.timestamp_micros("_us"), window).alias("_w"))
        .agg(
            F.max_by("_after", "_us").alias("active_at_end"),
            F.max(F.greatest("_before", "_after")).alias("peak"),
        )
        .select(
            F.col("_w.start").alias("window_start"),
            "active_at_end",
            "peak",
            (F.col("peak") > cap).alias("over_cap"),
        )
    )


def with_request_id(log: DataFrame, row_key: list[str]) -> DataFrame:
    """Keep a supplied request id; give the others one derived from the row's own key."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in row_key]
    made = F.sha2(F.concat_ws("\u0001", *parts), 256)
    return log.withColumn("request_id", F.coalesce("request_id", made))


def audit_trail(
    log: DataFrame, receipts: DataFrame, outcomes: DataFrame, row_key: list[str]
) -> DataFrame:
    """Each request with its stream's outcome and receipt, by request id."""
    return (
        with_request_id(log, row_key)
        .join(outcomes, "request_id", "left")
        .join(receipts, "request_id", "left")
    )
