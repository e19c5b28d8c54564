"""Registered queries over the test tables, and the same results as SQL."""

from __future__ import annotations

import sys
import tempfile
import uuid
import warnings
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blackbar.functions.patterns import TOKEN, Dictionary, collect_dictionary
from blackbar.operators import chunks as C
from blackbar.operators import frames as FR
from blackbar.operators import receipts as RC
from blackbar.operators import requests as RQ
from blackbar.operators import streams as ST
from blackbar.operators import text as TX
from blackbar.operators import vault as VT
from blackbar.plans import wide_dictionary
from blackbar.plans.ordered import recut
from blackbar.plans.skew import salted_join
from blackbar.session import cut_lineage
from blackbar.sources import tables
from blackbar.streaming import redact as SR

try:  # the training-data operators are an optional part
    import corpus_pipeline
    from blackbar.llm import registry as LLM
except ImportError as error:
    warnings.warn(f"queries of the training-data operators are not registered: {error}", stacklevel=1)
    LLM = None

# Occurrences of these can never overlap ...
PLAIN = ["the", "é", "License", "+1", "Apache", "token", "MIT"]
# ... of these they can ("the" ends in the first letter of "example"), and one is shadowed.
OVERLAPPING = [*PLAIN, "example.com", "example"]
LABELS = [f"<{i}>" for i in range(len(OVERLAPPING))]


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return tables.spread_small(tables.read_table(spark, f"{sf}/{name}.parquet"))


def vault(spark: SparkSession, patterns: list[str], labels: list[str] | None = None) -> DataFrame:
    return VT.vault_from_lists(spark, patterns, labels)


def dictionary(spark: SparkSession, patterns: list[str], labels: list[str] | None = None) -> Dictionary:
    return collect_dictionary(vault(spark, patterns, labels))


# -- inputs derived from the tables --------------------------------------------------

# Valid in both SQL dialects.
_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
_LOG = f"""
    CAST(event_id AS STRING) AS request_id,
    CASE WHEN event_type <> 'signup' THEN 'POST' WHEN {_K} % 3 = 0 THEN 'GET' ELSE 'OPTIONS' END AS method,
    CASE WHEN {_K} % 10 = 1 THEN '/health' WHEN {_K} % 10 = 2 THEN '/nope'
         ELSE '/v1/chat/completions' END AS path,
    CASE WHEN user_id % 4 = 0 THEN 'https://app.example'
         WHEN user_id % 4 = 1 THEN 'https://other.example' END AS origin,
    CASE WHEN {_K} % 7 = 1 THEN 'bearer key' WHEN {_K} % 7 > 1 THEN 'Bearer key' END AS credentials,
    CASE WHEN {_K} % 5 = 0 THEN CAST({_K} * 50000 AS STRING) WHEN {_K} % 5 = 1 THEN '+99999999'
         WHEN {_K} % 5 = 2 THEN 'abc' END AS content_length,
    {_K} * 30000 AS body_bytes,
    CASE WHEN {_K} % 9 = 0 THEN 429 WHEN {_K} % 9 = 1 THEN 503 WHEN {_K} % 9 = 2 THEN 204
         WHEN {_K} % 9 = 3 THEN NULL ELSE 200 END AS upstream_status,
    {_K} % 9 = 3 AS send_error,
    CASE WHEN {_K} % 9 = 0 THEN CAST(user_id AS STRING) END AS retry_after,
    CASE WHEN {_K} % 2 = 0 THEN 'application/json' END AS content_type
"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with a TIMESTAMP that does not depend on the session time zone."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return load(spark, sf, "events").withColumn("us", us).withColumn(
        "ts", F.timestamp_micros("us")
    )


def request_log(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).selectExpr("ts", *_split_columns(_LOG))
    return rows.withColumn(
        "authorization_sha256", RQ.bearer_digest(F.col("credentials"))
    ).drop("credentials")


def _split_columns(select_list: str) -> list[str]:
    """The items of a select list, split at commas outside parentheses."""
    items, depth, current = [], 0, ""
    for c in select_list:
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            items.append(current)
            current = ""
        else:
            current += c
    return [*items, current]


def classified(spark: SparkSession, sf: str) -> DataFrame:
    origins = spark.createDataFrame([("https://app.example",)], "origin string")
    digests = spark.range(1).select(F.sha2(F.lit("key"), 256).alias("digest"))
    return RQ.classify_requests(request_log(spark, sf), origins, digests)


def document_chunks(spark: SparkSession, sf: str, size: int) -> DataFrame:
    return C.chunk_table(load(spark, sf, "documents"), "doc_id", "text", size)


def turn_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "conversations").select(
        F.col("conv_id").alias("stream_id"),
        F.col("turn").alias("seq"),
        F.encode("text", "UTF-8").alias("chunk"),
    )


def timed_chunks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Document chunks with times, some of them late or damaged, and the stream log."""
    docs = load(spark, sf, "documents")
    size = F.octet_length("text")
    n = F.ceil(size / 512)
    cut = C.chunk_table(docs, "doc_id", "text", 512)
    ends = docs.select(F.col("doc_id").alias("stream_id"), (n - 1).alias("_last"))
    late = (F.col("stream_id") % 5 == 0) & (F.col("seq") >= 2)
    damaged = (
        F.when((F.col("stream_id") % 7 == 0) & (F.col("seq") == 1), F.concat(F.expr("X'FF'"), "chunk"))
        .when(
            (F.col("stream_id") % 11 == 0) & (F.col("seq") == F.col("_last")),
            F.concat("chunk", F.expr("X'C3'")),
        )
        .otherwise(F.col("chunk"))
    )
    chunks = salted_join(cut, ends, ["stream_id"], "seq").select(
        "stream_id",
        "seq",
        F.timestamp_seconds(F.col("seq") * 10 + F.when(late, 20).otherwise(0)).alias("ts"),
        damaged.alias("chunk"),
    )
    d = F.col("stream_id")
    last = F.col("_last")
    ended = (
        last * 10
        + F.when((d % 5 == 0) & (last >= 2), 20).otherwise(0)
        + F.when(d % 13 == 0, 16).otherwise(1)
    )
    log = ends.select(
        "stream_id",
        F.timestamp_seconds(F.lit(0)).alias("started"),
        F.timestamp_seconds(ended).alias("ended"),
        F.when(d % 17 == 0, "read_error")
        .when(d % 19 == 0, "downstream_dropped")
        .otherwise("eof")
        .alias("end_reason"),
    )
    return chunks, log


def frame_fields(spark: SparkSession, sf: str) -> DataFrame:
    """One frame per 64 characters of a turn; odd turns go to choice 1, and system turns
    are tool arguments."""
    rows = load(spark, sf, "conversations")
    cuts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 64).cast("int"))
    parts = rows.select(
        "conv_id", "turn", "role", F.posexplode(F.transform(
            cuts, lambda i: F.col("text").substr(i * 64 + 1, F.lit(64))
        )).alias("part", "piece")
    )
    tool = F.col("role") == "system"
    no_function = F.lit(None).cast("struct<name:string,arguments:string>")
    delta = F.struct(
        F.when(F.col("part") == 0, F.col("role")).alias("role"),
        F.when(~tool, F.col("piece")).alias("content"),
        F.when(
            tool,
            F.struct(
                F.lit("call").alias("name"),
                F.col("piece").alias("arguments"),
                no_function.alias("function"),
            ),
        ).alias("tool_call"),
    )
    choice = F.struct(
        (F.col("turn") % 2).alias("index"),
        F.lit(None).cast("string").alias("finish_reason"),
        delta.alias("delta"),
    )
    return parts.select(
        "conv_id",
        "turn",
        (F.col("turn") * 100_000 + F.col("part")).alias("seq"),
        F.concat(F.lit("c"), "conv_id").alias("id"),
        F.lit(None).cast("string").alias("object"),
        F.col("turn").alias("created"),
        F.lit("m").alias("model"),
        F.array(choice).alias("choices"),
    )


def sse_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Each frame as event-stream text, followed by a malformed and a closing event."""
    body = F.concat(
        FR.render_sse(F.col("frame")), F.lit('data: {"id":5}\n\n'), F.lit("data: [DONE]\n\n")
    )
    return FR.render_sse_json(frame_fields(spark, sf)).select("conv_id", "seq", body.alias("body"))


def choice_rows(spark: SparkSession, sf: str) -> DataFrame:
    parsed = FR.parse_sse_frames(sse_bodies(spark, sf), ["conv_id", "seq"], "body")
    return FR.explode_choices(parsed, ["conv_id", "seq", "event_no"])


def run_stream(spark: SparkSession, chunks: DataFrame, d: Dictionary) -> DataFrame:
    """Land chunks as files, redact them as a stream, and read the sink."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir is not set; name a folder all executors share")
        base = tempfile.mkdtemp(prefix="blackbar-")
    folder = f"{base}/stream-{uuid.uuid4().hex}"
    last = chunks.groupBy("stream_id").agg(F.max("seq").alias("_end"))
    landed = salted_join(chunks, last, ["stream_id"], "seq").withColumn("eof", F.col("seq") == F.col("_end")).drop("_end")
    tables.write_table(landed, f"{folder}/in")
    stream = tables.read_stream(spark, f"{folder}/in", landed.schema)
    out = SR.redact_stream(stream, d, idle_ms=None)
    query = (
        tables.stream_writer(out, f"{folder}/out", f"q{uuid.uuid4().hex}", checkpoint=f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return tables.read_table(spark, f"{folder}/out", schema=out.schema)


# -- queries ---------------------------------------------------------------------------


def redaction_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Per source: texts, texts redacted, matches, bytes after redaction, largest digest."""
    d = dictionary(spark, OVERLAPPING)
    docs = load(spark, sf, "documents").select(
        "source",
        TX.match_count(F.col("text"), d).alias("n"),
        TX.redacted(F.col("text"), d).alias("redacted"),
    )
    return docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if(F.col("n") > 0).alias("redacted_texts"),
        F.sum("n").alias("matches"),
        F.sum(F.octet_length("redacted")).alias("redacted_bytes"),
        F.max(F.sha2("redacted", 256)).alias("largest_digest"),
    )


def q_parse_pattern_list(spark, sf):
    return VT.parse_pattern_list(load(spark, sf, "documents"), "text", ["doc_id"])


def q_vault_table(spark, sf):
    patterns = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("pattern_id"),
        F.concat("c_name", F.lit(" é")).alias("pattern"),
        F.concat(F.lit('<"'), "c_mktsegment", F.lit('\\">')).alias("replacement"),
    )
    return VT.vault_table(patterns)


def q_live_patterns(spark, sf):
    key = F.col("o_orderkey")
    patterns = load(spark, sf, "orders").select(
        key.alias("pattern_id"),
        F.md5(key.cast("string")).substr(F.lit(1), (4 + key % 4).cast("int")).alias("pattern"),
        F.lit(TOKEN).alias("replacement"),
    )
    return VT.live_patterns(VT.vault_table(patterns)).select("pattern_id", "pattern")


def q_filter_matching(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "source", "text")
    return TX.filter_matching(docs, "text", vault(spark, PLAIN)).select("doc_id", "source")


def q_find_matches(spark, sf):
    return TX.find_matches(
        load(spark, sf, "documents"), ["doc_id"], "text", vault(spark, OVERLAPPING)
    )


def q_find_matches_wide(spark, sf):
    return wide_dictionary.find_matches(
        load(spark, sf, "documents"), ["doc_id"], "text", vault(spark, OVERLAPPING)
    )


def q_redact_text(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text")
    return TX.redact_text(docs, "text", vault(spark, OVERLAPPING, LABELS))


def q_redact_text_wide(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text")
    return wide_dictionary.redact(docs, "text", vault(spark, OVERLAPPING, LABELS), "text").select(
        "doc_id", "text"
    )


def q_redact_constant(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text")
    return TX.redact_constant(docs, "text", vault(spark, PLAIN))


def q_segment_text(spark, sf):
    return TX.segment_text(
        load(spark, sf, "documents"), ["doc_id"], "text", vault(spark, OVERLAPPING)
    )


def q_redact_json_text(spark, sf):
    labels = ['the "k"\\', "zz"]
    rows = load(spark, sf, "events").select("event_id", "props")
    out = TX.redact_json_text(rows, "props", vault(spark, ["k", "zz"], labels))
    return out.withColumn("is_json", F.try_parse_json("props").isNotNull())


def q_redaction_counters(spark, sf):
    return TX.redaction_counters(
        load(spark, sf, "documents"), "text", vault(spark, OVERLAPPING), ["source"]
    )


def q_pattern_counters(spark, sf):
    return TX.pattern_counters(
        load(spark, sf, "documents"), "text", vault(spark, OVERLAPPING), ["lang"]
    )


def q_classify_utf8(spark, sf):
    binary = load(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    pieces = C.slice_segments(binary, ["doc_id"], "b", 7)
    return C.classify_utf8(pieces, "bytes").select("doc_id", "piece_no", "utf8_state", "valid_len")


def q_safe_boundary(spark, sf):
    rows = load(spark, sf, "conversations").select("conv_id", "turn", "text")
    return C.safe_boundary(rows, "text", vault(spark, OVERLAPPING)).drop("text")


def _pieces(rows: DataFrame) -> DataFrame:
    # The redacted stream is a table of its own before it is cut anew.
    return C.redacted_pieces(cut_lineage(rows), 4096).select(
        "stream_id",
        "piece_no",
        F.octet_length("redacted").alias("bytes"),
        F.sha2("redacted", 256).alias("digest"),
    )


def q_redact_chunked(spark, sf):
    return _pieces(C.redact_chunked(document_chunks(spark, sf, 256), vault(spark, PLAIN)))


def q_redact_chunked_overlapping(spark, sf):
    return _pieces(C.redact_chunked(document_chunks(spark, sf, 100), vault(spark, OVERLAPPING)))


def q_redact_stream(spark, sf):
    return _pieces(run_stream(spark, turn_chunks(spark, sf), dictionary(spark, OVERLAPPING)))


def q_hold_limit(spark, sf):
    rows = load(spark, sf, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("stream"), "text"
    )
    chunks = C.chunk_table(rows, "stream", "text", 6)
    return C.hold_limit(chunks, vault(spark, OVERLAPPING), 8)


def q_slice_segments(spark, sf):
    binary = load(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    return C.slice_segments(binary, ["doc_id"], "b", 100).select(
        "doc_id", "piece_no", F.hex("bytes").alias("hex_bytes")
    )


def q_stream_receipts(spark, sf):
    rows = C.redact_chunked(document_chunks(spark, sf, 1000), vault(spark, PLAIN))
    return RC.stream_receipts(cut_lineage(rows)).drop("scheme")


def q_stream_outcomes(spark, sf):
    chunks, log = timed_chunks(spark, sf)
    return ST.stream_outcomes(chunks, log, vault(spark, PLAIN))


def q_idle_timeouts(spark, sf):
    rows = events(spark, sf).select("event_id", "user_id", "ts")
    return ST.idle_timeouts(rows, "user_id", "ts", "1 hour").select("event_id", "dropped")


def q_idle_sessions(spark, sf):
    out = ST.idle_sessions(events(spark, sf), ["user_id"], "ts", "1 hour")
    return out.select(
        "user_id",
        F.unix_micros("first_ts").alias("first_us"),
        F.unix_micros("last_ts").alias("last_us"),
        "rows",
    )


def q_payload_limit(spark, sf):
    docs = load(spark, sf, "documents")
    n = F.octet_length("text").cast("string")
    lengths = docs.select(
        F.col("doc_id").alias("stream_id"),
        F.when(F.col("doc_id") % 4 == 0, n)
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("+00"), n))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("x"), n))
        .alias("declared"),
    )
    cut = C.chunk_table(docs, "doc_id", "text", 512)
    chunks = salted_join(cut, lengths, ["stream_id"], "seq")
    out = ST.payload_limit(chunks, 8192, "declared", key="stream_id")
    return out.select("stream_id", "seq", "total_bytes", "status")


def q_reconcile_bytes(spark, sf):
    d = dictionary(spark, PLAIN)
    docs = load(spark, sf, "documents").select("doc_id", "text")
    return TX.reconcile_bytes(
        docs,
        TX.redact_constant(docs, "text", d),
        TX.segment_text(docs, ["doc_id"], "text", d),
        ["doc_id"],
        "text",
        "text",
        d,
    )


def q_parse_sse_frames(spark, sf):
    parsed = FR.parse_sse_frames(sse_bodies(spark, sf), ["conv_id", "seq"], "body")
    return parsed.select(
        "conv_id", "seq", "event_no", "done", "malformed", "id", "created",
        F.size("choices").alias("n_choices"),
    )


def sse_chunks(spark: SparkSession, sf: str, size: int) -> DataFrame:
    """The event-stream bodies of a conversation as one stream, cut every ``size`` bytes.

    Every other body has lines that end in CR LF.
    """
    body = F.when(F.col("seq") % 2 == 1, F.replace("body", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("body"))
    cut = C.slice_segments(
        sse_bodies(spark, sf).select("conv_id", "seq", F.encode(body, "UTF-8").alias("_bytes")),
        ["conv_id", "seq"], "_bytes", size,
    )
    return cut.select(
        F.col("conv_id").alias("stream_id"),
        (F.col("seq") * 1000 + F.col("piece_no")).alias("seq"),
        F.col("bytes").alias("chunk"),
    )


def q_sse_events_from_chunks(spark, sf):
    return FR.parse_sse_chunks(sse_chunks(spark, sf, 7)).select(
        F.col("stream_id").alias("conv_id"), "event_no", "done", "malformed", "id", "created",
        F.size("choices").alias("n_choices"), F.col("choices")[0]["delta"]["content"].alias("content"),
    )


def q_explode_choices(spark, sf):
    return choice_rows(spark, sf).select(
        "conv_id", "seq", "choice_no", "choice_index", "role", "content", "tool_name", "tool_arguments"
    )


def q_render_sse_json(spark, sf):
    rows = FR.render_sse_json(frame_fields(spark, sf))
    field = lambda path: F.get_json_object("frame", path)
    return rows.select(
        "conv_id",
        "seq",
        field("$.id").alias("id"),
        field("$.object").alias("object"),
        field("$.choices[0].index").cast("bigint").alias("choice_index"),
        field("$.choices[0].delta.content").alias("content"),
        F.contains("frame", F.lit("null,")).alias("has_null"),
    )


def q_assemble_messages(spark, sf):
    out = FR.assemble_messages(choice_rows(spark, sf), ["conv_id"], "seq")
    return out.select("conv_id", "choice_index", "tool_index", "piece_no", "message")


def q_redact_by_choice(spark, sf):
    rows = FR.redact_by_choice(
        choice_rows(spark, sf), ["conv_id"], "seq", vault(spark, OVERLAPPING)
    )
    lane = ["conv_id", "choice_index", "is_tool"]
    flat = rows.withColumn("is_tool", F.col("tool_index").isNotNull())
    return recut(cut_lineage(flat), lane, "seq", "redacted", 4096)


def q_classify_requests(spark, sf):
    return classified(spark, sf).select("request_id", "status", "reason")


def q_origin_allowlist(spark, sf):
    origins = spark.createDataFrame([("https://app.example",)], "origin string")
    return RQ.origin_allowlist(request_log(spark, sf), origins).select("request_id", "origin_allowed")


def q_upstream_error_rollup(spark, sf):
    return RQ.upstream_error_rollup(classified(spark, sf))


def q_error_body_prefix(spark, sf):
    out = ST.error_body_prefix(
        document_chunks(spark, sf, 700), 2000, key="stream_id", vault=vault(spark, PLAIN)
    )
    return out.select("stream_id", F.hex("body").alias("body"))


def q_request_counters(spark, sf):
    return RQ.request_counters(classified(spark, sf))


def q_event_rate(spark, sf):
    out = RQ.event_rate(events(spark, sf), "ts", "1 hour", "10 minutes", ["event_type"])
    return out.select(
        "event_type", F.unix_micros("window_start").alias("start_us"), "events", "rate"
    )


def q_active_streams(spark, sf):
    rows = events(spark, sf).select(
        F.col("ts").alias("started"),
        F.timestamp_micros(F.col("us") + F.expr(_K).cast("bigint") * 60_000_000).alias("ended"),
    )
    out = RQ.active_streams(rows, "1 hour", 12)
    return out.select(
        F.unix_micros("window_start").alias("start_us"), "active_at_end", "peak", "over_cap"
    )


def q_audit_trail(spark, sf):
    chunks, log = timed_chunks(spark, sf)
    d = dictionary(spark, PLAIN)
    name = F.concat(F.lit("r"), F.col("stream_id"))
    outcomes = ST.stream_outcomes(chunks, log, d).select(name.alias("request_id"), "outcome")
    done = outcomes.where("outcome = 'completed'").select("request_id")
    receipts = (
        RC.stream_receipts(cut_lineage(C.redact_chunked(chunks, d)))
        .select(name.alias("request_id"), "receipt")
        .join(done, "request_id", "left_semi")
    )
    requests = load(spark, sf, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("r"), "doc_id")).alias("request_id"),
    )
    return RQ.audit_trail(requests, receipts, outcomes, ["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {n[2:]: f for n, f in globals().items() if n.startswith("q_")}
    found = {"redaction_summary": redaction_summary, **found}
    if LLM:
        found |= {**LLM.QUERIES, "pipeline": corpus_pipeline.run}
    return found


def entry(spark: SparkSession) -> DataFrame:
    return redaction_summary(spark, "/root/testdata/sf0.001")


def oracle_sql() -> dict[str, str]:
    from blackbar_oracle import ORACLE

    found = dict(ORACLE)
    if LLM:
        found |= LLM.ORACLE
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
