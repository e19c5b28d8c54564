import re
import random
import time

import model
from pyspark.sql import functions as F

from blackbar.functions.patterns import collect_dictionary
from blackbar.operators import chunks as C
from blackbar.operators import vault as V
from blackbar.sources import tables
from blackbar.streaming import rates
from blackbar.streaming import redact as S


def rules(patterns, **kw):
    live = [patterns[i] for i in model.live(patterns)]
    limits = {"capacity": 65536, "early_bytes": 10**6, **kw}
    return S.stream_rules(live, b"[REDACTED]", **limits)


def test_step_agrees_with_the_model():
    rng = random.Random(11)
    alphabet = [b"a", b"b", b"c", "é".encode(), b"\xe2\x82\xac", b"\xc3"]
    for _ in range(3000):
        size = rng.choice([3, 4, 5, 6])
        patterns = [
            b"".join(rng.choice(alphabet[:4]) for _ in range(rng.randint(1, 4)))
            for _ in range(rng.randint(1, 4))
        ]
        chunks = [
            b"".join(rng.choice(alphabet[:size]) for _ in range(rng.choice([0, 1, 2, 5])))
            for _ in range(rng.randint(1, 8))
        ]
        wanted = model.stream(patterns, chunks, b"[REDACTED]")
        arrivals = [(i, c, i == len(chunks) - 1) for i, c in enumerate(chunks)]
        arrivals += [rng.choice(arrivals) for _ in range(3)]
        rng.shuffle(arrivals)
        state, got = S.StreamState(), []
        while arrivals:
            n = rng.randint(1, 4)
            got += S.advance(state, arrivals[:n], rules(patterns))
            arrivals = arrivals[n:]
            state = S.StreamState.from_row(state.as_row())
        assert [r for r in got if r[2] != "late"] == wanted


def test_step_with_patterns_of_thousands_of_bytes():
    word = "".join(chr(97 + k * k % 23) for k in range(8000))
    near = word[:4000] + "!"
    patterns = [word, near + "zz", "secret"]
    text = ("a" * 50 + word + "secret" + near + "zz" + word[:7999] + near + "z" + word[:20]).encode()
    whole = re.sub("|".join(map(re.escape, patterns)).encode(), b"[REDACTED]", text)
    for size in (1, 333, 5000):
        state, out = S.StreamState(), b""
        limits = S.stream_rules([p.encode() for p in patterns], b"[REDACTED]", 1 << 16)
        for at in range(0, len(text), size):
            out += S.push(state, text[at : at + size], at + size >= len(text), limits)
        assert out == whole and state.status == "completed"


def test_limits_and_late_chunks():
    state = S.StreamState()
    assert list(S.advance(state, [(0, b"sensitiv", False)], rules([b"sensitive"], capacity=4))) == [
        (0, b"", "buffer_limit")
    ]
    assert list(S.advance(state, [(1, b"x", False), (0, b"y", False)], rules([b"a"]))) == [(1, b"", "late")]
    state = S.StreamState()
    got = list(S.advance(state, [(1, b"x" * 20, False)], rules([b"a"], early_bytes=10)))
    assert got == [(0, b"", "reorder_limit"), (1, b"", "late")]


def test_stream_equals_batch_across_a_restart(spark, tmp_path):
    vault = collect_dictionary(V.vault_from_lists(spark, ["the", "é", "token", "that the"]))
    docs = tables.read_table(spark, "/root/testdata/sf0.001/documents.parquet")
    cut = C.chunk_table(docs, "doc_id", "text", 97)
    last = cut.groupBy("stream_id").agg(F.max("seq").alias("last"))
    chunks = cut.join(last, "stream_id").select(
        F.col("stream_id").cast("string").alias("stream_id"),
        "seq",
        F.timestamp_seconds("seq").alias("ts"),
        "chunk",
        (F.col("seq") == F.col("last")).alias("eof"),
    )
    twice = chunks.unionByName(chunks.where("seq % 5 = 0"))
    source = str(tmp_path / "in")
    twice.repartition(4, F.rand(1)).write.parquet(source)

    def run(limit_files):
        stream = tables.read_stream(spark, source, files_per_trigger=1)
        out = S.redact_stream(stream, vault, idle_ms=None)
        writer = tables.stream_writer(out, str(tmp_path / "out"), "q", checkpoint=str(tmp_path / "cp"))
        if limit_files:
            query = writer.start()
            for _ in range(600):
                if not query.isActive or len(query.recentProgress) >= 2:
                    break
                time.sleep(0.1)
            assert query.exception() is None
            query.stop()
        else:
            writer.trigger(availableNow=True).start().awaitTermination(60)

    run(True)
    run(False)
    got = spark.read.parquet(str(tmp_path / "out")).where("status <> 'late'")
    wanted = C.redact_chunked(chunks, vault, eof="eof")
    assert got.count() == wanted.count() == chunks.count()
    assert got.exceptAll(wanted).count() == 0


def test_idle_stream_is_ended(spark, tmp_path):
    vault = V.vault_from_lists(spark, ["password"])
    rows = spark.createDataFrame([("s", 0, None, b"my pass", False)], tables.CHUNKS)
    rows.write.parquet(str(tmp_path / "in"))
    stream = tables.read_stream(spark, str(tmp_path / "in"))
    out = S.redact_stream(stream, vault, idle_ms=1000)
    query = (
        tables.stream_writer(out, str(tmp_path / "out"), "idle", checkpoint=str(tmp_path / "cp"))
        .trigger(processingTime="500 milliseconds")
        .start()
    )
    try:
        got = []
        for _ in range(120):
            time.sleep(0.5)
            if query.lastProgress:
                got = spark.read.schema(out.schema).parquet(str(tmp_path / "out")).orderBy("seq").collect()
            if len(got) == 2:
                break
    finally:
        query.stop()
    assert [(r.seq, bytes(r.redacted), r.status) for r in got] == [
        (0, b"my ", "open"), (1, b"", "idle_timeout"),
    ]


def test_rate_stream(spark, tmp_path):
    events = tables.read_table(spark, "/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = tables.read_stream(spark, str(tmp_path / "in"), events.schema)
    out = rates.event_rate_stream(stream, "ts", "1 hour", "15 minutes", ["event_type"])
    tables.stream_writer(out, str(tmp_path / "out"), "rate", checkpoint=str(tmp_path / "cp")).trigger(
        availableNow=True
    ).start().awaitTermination(60)
    from blackbar.operators.requests import event_rate

    got = spark.read.parquet(str(tmp_path / "out"))
    batch = event_rate(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "15 minutes", ["event_type"])
    assert got.count() > 100
    assert got.exceptAll(batch).count() == 0


def test_many_early_chunks_wait_without_a_limit():
    chunk = b"x" * 100_000
    state = S.StreamState()
    free = rules([b"secret"], early_bytes=None)
    assert list(S.advance(state, [(i, chunk, i == 200) for i in range(1, 201)], free)) == []
    got = list(S.advance(state, [(0, b"sec", False)], free))
    assert len(got) == 201 and got[-1][2] == "completed"
    assert sum(len(r[1]) for r in got) == 200 * len(chunk) + 3
