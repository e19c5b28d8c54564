import random
from datetime import datetime, timedelta, timezone

from blackbar.operators import requests as Q
from blackbar.operators import streams as S
from blackbar.operators import vault as V
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_idle_waits(spark):
    chunks = spark.createDataFrame(
        [("first", 0, at(16)), ("exact", 0, at(0)), ("exact", 1, at(15)), ("end", 0, at(0)),
         ("mid", 0, at(1)), ("mid", 1, at(17)), ("mid", 2, at(18))],
        "stream_id string, seq bigint, ts timestamp",
    )
    streams = spark.createDataFrame(
        [("first", at(0), at(17)), ("exact", at(0), at(30)), ("end", at(0), at(16)), ("mid", at(0), None)],
        "stream_id string, started timestamp, ended timestamp",
    )
    cuts = {r.stream_id: r for r in S.idle_cuts(chunks, "stream_id", "ts", streams=streams).collect()}
    assert set(cuts) == {"first", "end", "mid"}
    assert cuts["mid"].cut_at == at(16).replace(tzinfo=None)
    rows = S.idle_timeouts(chunks, "stream_id", "ts", streams=streams).collect()
    assert {(r.stream_id, r.seq) for r in rows if r.dropped} == {("first", 0), ("mid", 1), ("mid", 2)}


def test_idle_random(spark):
    rng = random.Random(6)
    rows, wanted, sessions = [], set(), set()
    for k in range(30):
        t, previous, dropped, run = -3 * 10**8, None, False, None
        for s in range(60):
            t += rng.choice([0, 1, 500_000, 999_999, 1_000_000, 1_000_001, 20_000_000 if k % 3 else 1])
            dropped = dropped or (previous is not None and t - previous > 1_000_000)
            if previous is None or t - previous > 1_000_000:
                if run:
                    sessions.add((k, *run))
                run = [t, t, 0]
            run[1], run[2] = t, run[2] + 1
            previous = t
            rows.append((k, s, t))
            if dropped:
                wanted.add((k, s))
        sessions.add((k, *run))
    df = spark.createDataFrame(rows, "k int, s int, us bigint").withColumn("ts", F.timestamp_micros("us"))
    got = S.idle_timeouts(df, "k", "ts", "1 second")
    assert {(r.k, r.s) for r in got.where("dropped").collect()} == wanted
    got = S.idle_sessions(df, ["k"], "ts", "1 second").select(
        "k", F.unix_micros("first_ts"), F.unix_micros("last_ts"), "rows"
    )
    assert {tuple(r) for r in got.collect()} == sessions


def test_payload_limit(spark):
    sizes = {"a": [3, 4, 0, 4, 1], "b": [11], "c": [1], "d": [1], "e": [2]}
    declared = {"a": None, "b": None, "c": "11", "d": "+0010", "e": "99999999999999999999999"}
    df = spark.createDataFrame(
        [(k, i, b"x" * n, declared[k]) for k, ns in sizes.items() for i, n in enumerate(ns)],
        "request_id string, seq bigint, chunk binary, length string",
    )
    rows = S.payload_limit(df, 10, "length").collect()
    got = {(r.request_id, r.seq): r.status for r in rows}
    assert got == {
        ("a", 0): "accepted", ("a", 1): "accepted", ("a", 2): "accepted",
        ("a", 3): "body_too_large", ("a", 4): "body_too_large", ("b", 0): "body_too_large",
        ("c", 0): "declared_too_large", ("d", 0): "accepted", ("e", 0): "accepted",
    }


def test_error_body_prefix(spark):
    rows = [
        ("a", 0, b"pass", at(0), False), ("a", 1, b"word12", at(1), False),
        ("gap", 0, b"x", at(0), False), ("gap", 1, b"y", at(4), False),
        ("slow", 0, b"x", at(2), False), ("slow", 1, b"y", at(4), False), ("slow", 2, b"z", at(6), False),
        ("bad", 0, b"x", at(0), False), ("bad", 1, b"y", at(0), True), ("bad", 2, b"z", at(0), False),
    ]
    df = spark.createDataFrame(
        rows, "request_id string, seq bigint, chunk binary, ts timestamp, failed boolean"
    ).withColumn("started", F.lit(at(0)))
    vault = V.vault_from_lists(spark, ["password"])
    call = dict(limit=9, ts="ts", started="started", failed="failed")
    got = {r.request_id: bytes(r.body) for r in S.error_body_prefix(df, raw=True, **call).collect()}
    assert got == {"a": b"password1", "gap": b"x", "slow": b"xy", "bad": b"x"}
    got = {r.request_id: bytes(r.body) for r in S.error_body_prefix(df, vault=vault, **call).collect()}
    assert got["a"] == b"[REDACTED]1"


def test_outcomes(spark):
    chunks = {
        "ok": [(b"a", 0)], "bad": [(b"a", 0), (b"\xff", 1), (b"a", 30)], "cut": [(b"a\xc3", 0)],
        "idle": [(b"a", 0), (b"\xff", 20)], "full": [(b"sensitiv", 0), (b"x", 1)],
        "read": [(b"a", 0)], "drop": [(b"a", 0)], "quiet": [(b"a", 0)],
    }
    df = spark.createDataFrame(
        [(k, i, at(t), c) for k, cs in chunks.items() for i, (c, t) in enumerate(cs)],
        "stream_id string, seq bigint, ts timestamp, chunk binary",
    )
    reasons = {"read": "read_error", "drop": "downstream_dropped"}
    ended = {"bad": 31, "idle": 21, "quiet": 16}
    streams = spark.createDataFrame(
        [(k, at(0), at(ended.get(k, 2)), reasons.get(k, "eof")) for k in [*chunks, "empty"]],
        "stream_id string, started timestamp, ended timestamp, end_reason string",
    )
    vault = V.vault_from_lists(spark, ["sensitive"])
    rows = S.stream_outcomes(df, streams, vault, capacity=5).collect()
    assert {r.stream_id: (r.outcome, r.failed_seq) for r in rows} == {
        "ok": ("completed", None), "bad": ("invalid_utf8", 1), "cut": ("rejected_at_end", None),
        "idle": ("idle_timeout", 1), "full": ("buffer_limit", 0), "read": ("read_error", None),
        "drop": ("downstream_dropped", None), "quiet": ("idle_timeout", None),
        "empty": ("completed", None),
    }


def log(spark, rows):
    names = "request_id path method origin token length body upstream error".split()
    base = dict(
        path=Q.CHAT_PATH, method="POST", origin=None, token="Bearer key", length=None,
        body=10, upstream=200, error=False,
    )
    full = [[{**base, **r, "request_id": str(i)}[n] for n in names] for i, r in enumerate(rows)]
    df = spark.createDataFrame(
        full,
        "request_id string, path string, method string, origin string, token string, "
        "length string, body bigint, upstream int, error boolean",
    )
    return df.select(
        "request_id",
        F.timestamp_seconds(F.col("request_id").cast("int")).alias("ts"),
        "path", "method", "origin",
        Q.bearer_digest(F.col("token")).alias("authorization_sha256"),
        F.col("length").alias("content_length"),
        F.col("body").alias("body_bytes"),
        F.col("upstream").alias("upstream_status"),
        F.col("error").alias("send_error"),
        F.lit("17").alias("retry_after"),
        F.lit("application/json").alias("content_type"),
    )


def test_classify_and_count(spark):
    big = str(3 * 1024 * 1024)
    cases = [
        ({}, 200), ({"upstream": 204}, 200), ({"upstream": 429}, 429), ({"upstream": 304}, 304),
        ({"error": True, "upstream": None}, 502), ({"body": 2 * 1024 * 1024 + 1}, 413),
        ({"length": big}, 413), ({"length": "x" + big}, 200), ({"length": "+" + big}, 413),
        ({"token": None}, 401), ({"token": "bearer key"}, 401), ({"token": "Bearer  key"}, 401),
        ({"method": "GET"}, 405), ({"method": "GET", "token": None}, 401),
        ({"path": "/x", "token": None}, 404), ({"path": "/x", "method": "OPTIONS"}, 200),
        ({"path": "/health", "method": "HEAD", "token": None}, 200),
        ({"path": "/metrics", "token": None}, 405), ({"origin": "https://a"}, 200),
        ({"origin": "https://A"}, 403), ({"origin": "é"}, 200), ({"origin": "", "method": "OPTIONS"}, 403),
        ({"length": big, "origin": "https://b"}, 403), ({"length": big, "path": "/x"}, 413),
    ]
    origins = spark.createDataFrame([("https://a",)], "origin string")
    digests = spark.range(1).select(F.sha2(F.lit("key"), 256).alias("digest"))
    out = Q.classify_requests(log(spark, [c for c, _ in cases]), origins, digests)
    got = [r.status for r in out.orderBy(F.col("request_id").cast("int")).collect()]
    assert got == [s for _, s in cases]
    totals = Q.request_counters(out).where("status is null").first()
    assert (totals.proxy_gateway_error_total, totals.upstream_error_total) == (1, 2)
    assert totals.proxy_requests_total == 9
    errors = {r.status: r for r in Q.upstream_error_rollup(out).collect()}
    assert errors[429].errors == 1 and errors[429].last_retry_after == "17"
    none = spark.createDataFrame([], "origin string")
    flagged = Q.origin_allowlist(log(spark, [{}, {"origin": "https://a"}]), none)
    assert [r.origin_allowed for r in flagged.orderBy("request_id").collect()] == [True, False]


def test_active_streams(spark):
    streams = spark.createDataFrame(
        [(at(0), at(5)), (at(1), at(200)), (at(5), at(6)), (at(190), None), (at(7200), at(7201))],
        "started timestamp, ended timestamp",
    )
    got = {
        (r.window_start.hour * 60 + r.window_start.minute): (r.active_at_end, r.peak, r.over_cap)
        for r in Q.active_streams(streams, cap=1).collect()
    }
    assert got == {0: (1, 2, True), 3: (1, 2, True), 120: (1, 2, True)}


def test_event_rate(spark):
    rng = random.Random(1)
    times = [round(rng.uniform(0, 400), 3) for _ in range(300)]
    df = spark.createDataFrame([(at(t),) for t in times], "ts timestamp")
    fast = {tuple(r) for r in Q.event_rate(df, "ts").collect()}
    starts = [5 * k for k in range(-11, 81)]
    wanted = {}
    for s in starts:
        n = sum(s <= t < s + 60 for t in times)
        if n:
            wanted[at(s).replace(tzinfo=None)] = (n, n / 60)
    assert {r[0]: (r[2], r[3]) for r in fast} == wanted
    odd = Q.event_rate(df, "ts", "1 minute", "7 seconds").agg(F.sum("events")).first()[0]
    assert odd > 300


def test_audit_trail(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "request_id string, n int")
    receipts = spark.createDataFrame([("a", "r")], "request_id string, receipt string")
    outcomes = spark.createDataFrame([("a", "completed")], "request_id string, outcome string")
    rows = Q.audit_trail(df, receipts, outcomes, ["n"]).orderBy("n").collect()
    assert (rows[0].outcome, rows[0].receipt) == ("completed", "r")
    assert rows[1].request_id != rows[2].request_id and rows[1].receipt is None


def test_streams_without_an_end_are_open(spark):
    chunks = spark.createDataFrame([(i, 0, at(1), b"x") for i in (1, 2, 3)], "stream_id int, seq int, ts timestamp, chunk binary")
    streams = spark.createDataFrame(
        [(1, at(0), at(2), "eof"), (2, at(0), None, None), (3, at(0), at(2), "read_error")],
        "stream_id int, started timestamp, ended timestamp, end_reason string",
    )
    rows = S.stream_outcomes(chunks, streams, V.vault_from_lists(spark, ["secret"])).collect()
    assert {r.stream_id: r.outcome for r in rows} == {1: "completed", 2: "open", 3: "read_error"}


def test_error_bodies_show_no_part_of_a_match(spark):
    text = "my password here, é password"
    df = spark.createDataFrame([(1, i, text.encode()[i : i + 1]) for i in range(len(text.encode()))], "request_id int, seq int, chunk binary")
    vault = V.vault_from_lists(spark, ["password"])
    for limit in range(1, 30):
        cut = text.encode()[:limit]
        for begin in (3, 21):
            if begin < limit < begin + 8:
                cut = text.encode()[:begin] + b"password"
        want = cut.replace(b"password", b"[REDACTED]")
        got = S.error_body_prefix(df, limit, vault=vault).first().body
        assert bytes(got) == want, limit
