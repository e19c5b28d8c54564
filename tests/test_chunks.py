import hashlib
import random

import model
import pytest
from pyspark.sql import functions as F

from blackbar.operators import chunks as C
from blackbar.operators import receipts as R
from blackbar.operators import vault as V
from blackbar.plans import ordered

TOKEN = "[REDACTED]"


def table(spark, streams):
    rows = [(k, i, c) for k, cs in streams.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "stream_id string, seq bigint, chunk binary")


def by_stream(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.stream_id, r.seq)):
        out.setdefault(r.stream_id, []).append((r.seq, bytes(r.redacted), r.status))
    return out


def test_split_character_and_patterns(spark):
    vault = V.vault_from_lists(spark, ["password", "email@example.com"])
    chunks = [b"hello \xf0\x9f", b"\x9a\x80 password e", b"mail@example.com"]
    rows = by_stream(C.redact_chunked(table(spark, {"s": chunks}), vault))["s"]
    assert b"".join(r[1] for r in rows) == "hello 🚀 [REDACTED] [REDACTED]".encode()
    assert [r[2] for r in rows] == ["open", "open", "completed"]


@pytest.mark.parametrize(
    "patterns, chunks, expected",
    [
        (["password", "dog"], [b"my password", b" ok"], b"my [REDACTED] ok"),
        (["abca"], [b"xxxabca", b"zz"], b"xxx[REDACTED]zz"),
    ],
)
def test_no_leak_at_a_cut(spark, patterns, chunks, expected):
    vault = V.vault_from_lists(spark, patterns)
    rows = by_stream(C.redact_chunked(table(spark, {"s": chunks}), vault))["s"]
    assert b"".join(r[1] for r in rows) == expected


def test_frame_byte_by_byte(spark):
    frame = 'data: {"choices":[{"delta":{"content":"Hello 🚀, email: test@example.com"}}]}\n\n'
    vault = V.vault_from_lists(spark, ["test@example.com"])
    chunks = [bytes([b]) for b in frame.encode()]
    rows = by_stream(C.redact_chunked(table(spark, {"s": chunks}), vault))["s"]
    assert b"".join(r[1] for r in rows) == frame.replace("test@example.com", TOKEN).encode()


def random_streams(rng, alphabet, n=60):
    streams = {}
    for k in range(n):
        data = b"".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        chunks, at = [], 0
        while at < len(data):
            step = rng.choice([0, 1, 1, 2, 3, 7])
            chunks.append(data[at:at + step])
            at += step
        streams[f"s{k:03d}"] = chunks or [b""]
    return streams


def test_random_streams_agree_with_the_model(spark):
    rng = random.Random(3)
    cases = [
        ["ab", "bé"],  # can overlap
        ["aba", "bab", "é"],  # can overlap
        ["aa"],  # overlaps itself
        ["abé", "ca"],  # cannot
        ["c"],
    ]
    alphabet = [b"a", b"b", b"c", "é".encode(), b"a", b"b", b"\xe2\x82\xac", b"\xc3"]
    for patterns in cases:
        streams = random_streams(rng, alphabet[: rng.choice([6, 7, 8])])
        vault = V.vault_from_lists(spark, patterns)
        got = by_stream(C.redact_chunked(table(spark, streams), vault))
        words = [p.encode() for p in patterns]
        assert got == {
            k: model.stream(words, cs, TOKEN.encode()) for k, cs in streams.items()
        }, patterns


def test_long_runs_cross_scan_blocks(spark):
    # Thousands of one-byte chunks: states have to travel over many blocks.
    rng = random.Random(5)
    data = bytes(rng.choice(b"aab") for _ in range(3000))
    streams = {"s": [bytes([b]) for b in data]}
    for patterns in (["aa"], ["aab"], ["baaa", "aba"]):
        vault = V.vault_from_lists(spark, patterns)
        got = by_stream(C.redact_chunked(table(spark, streams), vault))["s"]
        whole = model.redact([p.encode() for p in patterns], data, TOKEN.encode())
        assert b"".join(r[1] for r in got) == whole


def test_eof_column_leaves_unfinished_streams_open(spark):
    vault = V.vault_from_lists(spark, ["abc"])
    df = spark.createDataFrame(
        [("x", 0, b"1ab", False), ("x", 1, None, True), ("y", 0, b"1ab", None)],
        "stream_id string, seq bigint, chunk binary, eof boolean",
    )
    got = by_stream(C.redact_chunked(df, vault, eof="eof"))
    assert got == {
        "x": [(0, b"1", "open"), (1, b"ab", "completed")],
        "y": [(0, b"1", "open")],
    }


def test_classify_utf8(spark):
    cases = [b"\xff", b"\xf0\x9f", b"\xed\xa0", b"\xe0\x9f", b"", "aé".encode(), b"a\xc3", b"\xc3a"]
    df = spark.createDataFrame(list(enumerate(cases)), "id int, b binary")
    rows = C.classify_utf8(df, "b").orderBy("id").collect()
    assert [(r.utf8_state, r.valid_len) for r in rows] == [
        ("invalid", None), ("incomplete", 0), ("invalid", None), ("invalid", None),
        ("valid", 0), ("valid", 3), ("incomplete", 1), ("invalid", None),
    ]
    rng = random.Random(1)
    pool = [0x00, 0x41, 0x7F, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC1, 0xC2, 0xDF, 0xE0, 0xE1,
            0xEC, 0xED, 0xEE, 0xEF, 0xF0, 0xF1, 0xF3, 0xF4, 0xF5, 0xFF]
    cases = [bytes(rng.choice(pool) for _ in range(rng.randint(0, 5))) for _ in range(20000)]
    df = spark.createDataFrame(list(enumerate(cases)), "id int, b binary")
    rows = C.classify_utf8(df, "b").orderBy("id").collect()
    for r, case in zip(rows, cases):
        if case[-2:-1] == b"\xed" and case[-1] >= 0xA0:
            assert r.utf8_state == "invalid"  # a surrogate can never be completed
        else:
            assert r.utf8_state == model.utf8_state(case), case


def test_safe_boundary(spark):
    df = spark.createDataFrame([("my pass",), ("Hello 🚀",), ("ab",), ("",)], "t string")
    vault = V.vault_from_lists(spark, ["xxxxx", "pass"])
    assert tuple(C.safe_boundary(df, "t", vault).first())[1:] == ("my pass", "")
    vault = V.vault_from_lists(spark, ["🚀abc"])
    rows = C.safe_boundary(df, "t", vault).collect()
    assert (rows[1].safe, rows[1].held) == ("Hello ", "🚀")
    assert (rows[2].safe, rows[2].held) == ("", "ab")
    rng = random.Random(2)
    samples = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 9))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(samples)), "id int, t string")
    for patterns in (["ab", "bé", "aba"], ["a"], ["é"], ["ééa", "b"]):
        vault = V.vault_from_lists(spark, patterns)
        words = [p.encode() for p in patterns]
        for r in C.safe_boundary(df, "t", vault).collect():
            assert r.safe + r.held == r.t
            assert len(r.held.encode()) == model.boundary(words, r.t.encode())


def test_hold_limit(spark):
    vault = V.vault_from_lists(spark, ["sensitive"])
    row = C.hold_limit(table(spark, {"s": [b"123456789"]}), vault, 8).first()
    assert (row.peak_held, row.exceeded_seq) == (9, 0)
    rng = random.Random(4)
    alphabet = [b"a", b"b", "é".encode(), b"\xc3", b"a", b"b"]
    for patterns, capacity in ((["abaé", "ba"], 3), (["a"], 1), (["aé", "bb"], 4)):
        streams = random_streams(rng, alphabet)
        words = [p.encode() for p in patterns]
        vault = V.vault_from_lists(spark, patterns)
        got = {
            r.stream_id: (r.peak_held, r.exceeded_seq)
            for r in C.hold_limit(table(spark, streams), vault, capacity).collect()
        }
        wanted = {}
        for k, cs in streams.items():
            sizes = model.held_sizes(words, cs)
            if sizes:
                over = [i for i, s in enumerate(sizes) if s > capacity]
                wanted[k] = (max(sizes), over[0] if over else None)
        assert got == wanted


def test_slices(spark):
    df = spark.createDataFrame([(0, b"abcdefghij"), (1, b"")], "id int, b binary")
    rows = C.slice_segments(df, ["id"], "b", 4).orderBy("piece_no").collect()
    assert [bytes(r.bytes) for r in rows] == [b"abcd", b"efgh", b"ij"]


def tree(data, leaf, bits, levels):
    digests = [hashlib.sha256(data[i:i + leaf]).digest() for i in range(0, len(data), leaf)]
    for level in range(levels):
        width = 2**bits if level < levels - 1 else len(digests)
        if len(digests) > 1:
            digests = [
                hashlib.sha256(b"".join(digests[i:i + width])).digest()
                for i in range(0, len(digests), width)
            ]
    return digests[0].hex() if digests else hashlib.sha256(b"").hexdigest()


def test_receipts_do_not_depend_on_the_cut(spark):
    vault = V.vault_from_lists(spark, ["password"])
    data = b"password stays private"
    streams = {
        "a": [data], "b": [bytes([x]) for x in data], "bad": [b"\xff"], "none": [b""],
    }
    rows = C.redact_chunked(table(spark, streams), vault)
    got = {r.stream_id: (r.receipt, r.bytes) for r in R.stream_receipts(rows).collect()}
    plain = hashlib.sha256(b"[REDACTED] stays private").hexdigest()
    assert got == {
        "a": (plain, 24), "b": (plain, 24), "none": (hashlib.sha256(b"").hexdigest(), 0),
    }
    rng = random.Random(8)
    contents = {f"s{i}": rng.randbytes(rng.choice([3, 4, 5, 40, 64, 65, 200])) for i in range(12)}
    for step in (1, 7, 64):
        df = table(
            spark,
            {k: [v[i:i + step] for i in range(0, len(v), step)] for k, v in contents.items()},
        ).withColumnRenamed("chunk", "redacted")
        got = R.stream_receipts(df, status=None, leaf_bytes=4, fanout_bits=2, levels=3)
        assert {r.stream_id: r.receipt for r in got.collect()} == {
            k: tree(v, 4, 2, 3) for k, v in contents.items()
        }


def test_receipts_follow_one_rule_at_every_length(spark):
    rng = random.Random(10)
    contents = {f"s{n}": rng.randbytes(n) for n in (0, 1, 2**20, 2**20 + 1, 3 * 2**20 + 5)}
    wanted = {(k, hashlib.sha256(v).hexdigest(), len(v), "sha256") for k, v in contents.items()}
    for step in (100_000, 2**21):
        streams = {k: [v[i:i + step] for i in range(0, len(v), step)] or [b""] for k, v in contents.items()}
        df = table(spark, streams).withColumnRenamed("chunk", "redacted")
        assert {tuple(r) for r in R.stream_receipts(df, status=None).collect()} == wanted


def test_running_sum_and_recut(spark):
    rng = random.Random(9)
    rows = [(k, s, rng.randint(0, 5)) for k in "ab" for s in sorted(rng.sample(range(5000), 300))]
    df = spark.createDataFrame(rows, "k string, s bigint, n int")
    got = ordered.running_sum(df, ["k"], "s", F.col("n"), "before", bits=(4, 3)).collect()
    total, wanted = {}, set()
    for k, s, n in rows:
        wanted.add((k, s, n, total.get(k, 0)))
        total[k] = total.get(k, 0) + n
    assert {tuple(r) for r in got} == wanted
    text = df.select("k", "s", F.expr("substr('éabcd', 1, n)").alias("t"))
    pieces = {}
    for r in ordered.recut(text, ["k"], "s", "t", 7).collect():
        pieces[(r.k, r.piece_no)] = r.t
    for k in "ab":
        whole = "".join("éabcd"[:n] for kk, _, n in rows if kk == k)
        assert [pieces[(k, i)] for i in range(-(-len(whole) // 7))] == [
            whole[i:i + 7] for i in range(0, len(whole), 7)
        ]


def test_chunks_delivered_twice_count_once(spark):
    rows = [(1, i, t) for i, t in enumerate([b"my pass", b"word", b" ok th", b"e end"])] + [(2, 0, b"x")]
    schema = "stream_id int, seq bigint, chunk binary"
    once, twice = spark.createDataFrame(rows, schema), spark.createDataFrame(rows + rows[:3], schema)
    for patterns in (["password", "the"], ["password", "dog", "the", "example", "ord"]):
        vault = V.vault_from_lists(spark, patterns)
        want, got = (
            sorted((r.stream_id, r.seq, bytes(r.redacted), r.status) for r in C.redact_chunked(df, vault).collect())
            for df in (once, twice)
        )
        assert got == want and len(got) == len(rows)


def test_chunks_without_a_key_are_refused(spark):
    df = spark.createDataFrame([(1, 0, b"a"), (None, 0, b"b")], "stream_id int, seq bigint, chunk binary")
    with pytest.raises(Exception, match="a chunk has no stream_id"):
        C.redact_chunked(df, V.vault_from_lists(spark, ["a"])).collect()
