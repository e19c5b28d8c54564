import json

import pytest
from pyspark.sql import functions as F

from blackbar.operators import chunks as C
from blackbar.operators import frames as FR
from blackbar.operators import vault as V
from blackbar.plans.ordered import ordered_scan

VALID = [
    "{}",
    '{"choices":[]}',
    '{"id":null,"choices":[{"index":0}]}',
    '{"x":1,"choices":[{"index":2,"delta":{"tool_call":{"name":"f"}}}]}',
    '{"choices":[{"index":0,"delta":null}]}',
    '{"created":12,"model":"m","choices":[{"index":0,"finish_reason":null,"delta":{"role":"r","content":""}}]}',
    '{"choices":[{"index":0,"delta":{"tool_call":{"name":"f","arguments":"{\\"a\\":1}","function":{"name":"g"}}}}]}',
]
MALFORMED = [
    '{"choices":null}',
    '{"choices":[{"delta":{"content":"mock"}}]}',
    '{"choices":[{"index":-1}]}',
    '{"choices":[{"index":"0"}]}',
    '{"choices":[{"index":1.0}]}',
    '{"choices":[{"index":null}]}',
    '{"choices":[1]}',
    '{"choices":{}}',
    '{"id":5}',
    '{"created":"12"}',
    '{"created":1.5}',
    '{"choices":[{"index":0,"delta":{"content":{"a":1}}}]}',
    '{"choices":[{"index":0,"delta":{"tool_call":{}}}]}',
    '{"choices":[{"index":0,"delta":{"tool_call":{"name":"f","function":{}}}}]}',
    '{"choices":[{"index":0,"delta":"x"}]}',
    "{} trailing",
    "{},{}",
    "",
    "null",
    "[]",
    "nonsense",
]


def test_contract(spark):
    df = spark.createDataFrame([(f,) for f in VALID + MALFORMED], "frame string")
    rows = {r.frame: r for r in FR.decode_frames(df).collect()}
    assert [f for f in VALID if rows[f].malformed] == []
    assert [f for f in MALFORMED if not rows[f].malformed] == []
    assert rows["{}"].choices == []
    assert rows[MALFORMED[0]].choices is None


def test_default_index(spark):
    df = spark.createDataFrame([(MALFORMED[1],), (MALFORMED[5],)], "frame string")
    rows = FR.decode_frames(df, default_index=0).collect()
    assert [r.malformed for r in rows] == [False, True]
    assert rows[0].choices[0]["index"] == 0


def sse(*objects):
    return "".join(f"data: {json.dumps(o, ensure_ascii=False)}\n\n" for o in objects)


def delta(index, **fields):
    return {"choices": [{"index": index, "delta": fields}]}


def test_split_and_done(spark):
    text = sse(delta(0, content="a\n\nb")) + "data: [DONE]\n\n" + "oops\r\n\r\n"
    df = spark.createDataFrame([(1, text)], "id int, body string")
    rows = FR.parse_sse_frames(df, ["id"], "body").orderBy("event_no").collect()
    assert [(r.event_no, r.done, r.malformed) for r in rows] == [
        (0, False, False), (1, True, False), (2, False, True),
    ]


def test_render_leaves_out_what_is_absent(spark):
    df = spark.createDataFrame([(f,) for f in VALID], "frame string")
    out = FR.render_sse_json(FR.decode_frames(df), "json").collect()
    for r in out:
        source = json.loads(r.frame)
        source = {k: v for k, v in source.items() if v is not None and k != "x"}
        source.setdefault("choices", [])
        for c in source["choices"]:
            for k in [k for k, v in c.items() if v is None]:
                del c[k]
        assert json.loads(r.json) == source


def frames(spark):
    rows = [
        (0, delta(0, content="my pass")),
        (1, delta(1, content="word")),
        (2, delta(0, content="word é", tool_call={"name": "f", "arguments": '{"a":"pas'})),
        (3, {"choices": [{"index": 0, "delta": {"tool_call": {"name": "f", "arguments": 'sword"}'}}},
                         {"index": 1, "delta": {"content": "!"}}]}),
        (4, {"choices": [{"index": 1, "delta": {"content": "a"}}, {"index": 1, "delta": {"content": "b"}}]}),
    ]
    df = spark.createDataFrame([("s", i, sse(o)) for i, o in rows], "stream_id string, seq bigint, body string")
    parsed = FR.parse_sse_frames(df, ["stream_id", "seq"], "body")
    assert parsed.where("malformed").count() == 0
    return FR.explode_choices(parsed, ["stream_id", "seq", "event_no"])


def test_assemble(spark):
    got = FR.assemble_messages(frames(spark), ["stream_id"], "seq").collect()
    assert {(r.choice_index, r.tool_index, r.piece_no): r.message for r in got} == {
        (0, None, 0): "my password é", (1, None, 0): "word!ab", (0, 0, 0): '{"a":"password"}',
    }
    got = FR.assemble_messages(frames(spark), ["stream_id"], "seq", 5).collect()
    content = {r.piece_no: r.message for r in got if (r.choice_index, r.tool_index) == (0, None)}
    assert content == {0: "my pa", 1: "sswor", 2: "d é"}


def test_pattern_cut_by_a_frame(spark):
    vault = V.vault_from_lists(spark, ["password"])
    rows = FR.redact_by_choice(frames(spark), ["stream_id"], "seq", vault).collect()
    lanes = {}
    for r in sorted(rows, key=lambda r: r.seq):
        lanes.setdefault((r.choice_index, r.tool_index), []).append(r.redacted)
    assert {k: "".join(v) for k, v in lanes.items()} == {
        (0, None): "my [REDACTED] é", (1, None): "word!ab", (0, 0): '{"a":"[REDACTED]"}',
    }


def test_comments_and_other_fields_are_no_part_of_a_frame(spark):
    body = ": ping\n\nevent: delta\nid: 7\ndata: {\"choices\":[]}\n\n: keep\ndata: {\"id\":\"a\"}\nretry: 5\n\ndata: [DONE]\n\n"
    df = spark.createDataFrame([(1, body)], "k int, body string")
    rows = FR.parse_sse_frames(df, ["k"], "body").orderBy("event_no").collect()
    assert [(r.done, r.malformed) for r in rows] == [(False, False), (False, False), (True, False)]
    assert rows[1].id == "a"


def test_function_arguments_are_a_lane_of_their_own(spark):
    def call(a, b):
        return {"choices": [{"index": 0, "delta": {"tool_call": {"name": "f", "arguments": a, "function": {"name": "g", "arguments": b}}}}]}

    df = spark.createDataFrame([(1, i, sse(call(a, b))) for i, (a, b) in enumerate([("pass", "sec"), ("word", "ret")])], "s int, seq int, body string")
    rows = FR.explode_choices(FR.parse_sse_frames(df, ["s", "seq"], "body"), ["s", "seq", "event_no"])
    whole = {r.tool_index: r.message for r in FR.assemble_messages(rows, ["s"], "seq").collect()}
    assert whole == {0: "password", 1: "secret"}
    vault = V.vault_from_lists(spark, ["password", "secret"])
    out = FR.redact_by_choice(rows, ["s"], "seq", vault).orderBy("tool_index", "seq").collect()
    assert ["".join(r.redacted for r in out if r.tool_index == t) for t in (0, 1)] == ["[REDACTED]"] * 2


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64])
def test_events_that_chunks_cut_anywhere(spark, size):
    bodies = [
        "data: a\n\ndata: b\n\n",
        "data: é1\r\n\r\n\r\n\r\ndata: 2\r\n: comment\r\ndata: 3\n\r\n\n\ndata: last\n",
        "data: z\n\n:only\n\nevent: x\nid: 1\ndata: y\n\n   \n\n\n\n\ndata: \U0001f600\r\r\n\n",
        "data: a\rb\n\rc\n\n\rdata: d",
        "no end",
        "",
    ]
    whole = spark.createDataFrame(list(enumerate(bodies)), "stream_id long, body string")
    rows = [
        (i, k // size, bytearray(b.encode()[k : k + size])) for i, b in enumerate(bodies) for k in range(0, len(b.encode()), size)
    ]
    cut = spark.createDataFrame(rows + rows[:5], "stream_id long, seq long, chunk binary")
    want = FR.split_sse(whole, ["stream_id"], "body").collect()
    got = FR.split_sse_chunks(cut).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_chunks_without_events(spark):
    rows = [(1, 0, bytearray(b"\n\r")), (1, 1, bytearray(b"\n\n")), (2, 0, None), (3, 4, bytearray(b":c\n\n"))]
    cut = spark.createDataFrame(rows, "stream_id long, seq long, chunk binary")
    assert FR.split_sse_chunks(cut).collect() == []
    assert FR.split_sse_chunks(cut.limit(0)).collect() == []
    with pytest.raises(Exception, match="no stream_id"):
        FR.split_sse_chunks(spark.createDataFrame([(None, 0, bytearray(b"x"))], cut.schema)).collect()


def test_small_chunks_are_joined_before_they_are_placed(spark, monkeypatch):
    text = "".join(f"data: {i}é\n\n" for i in range(1000)).encode()
    rows = [(k, i // 7, bytearray(text[i : i + 7])) for k in (1, 2) for i in range(0, len(text), 7)]
    cut = spark.createDataFrame(rows + rows[:50], "stream_id long, seq long, chunk binary")
    placed = []

    def scan(df, *args):
        placed.append(df.count())
        return ordered_scan(df, *args)

    monkeypatch.setattr(FR, "ordered_scan", scan)
    got = sorted(map(tuple, FR.split_sse_chunks(cut).collect()))
    assert got == [(k, i, f"{i}é") for k in (1, 2) for i in range(1000)]
    assert placed[0] <= 2 * (len(rows) // 2 // 1024 + 1)


def test_joined_chunks_are_bounded_and_in_order(spark, monkeypatch):
    monkeypatch.setattr(C, "_PACK_BYTES", 10)
    rows = [(1, 0, b"abcd"), (1, 2, b"efgh"), (1, 1, b""), (1, 3, b"ijklmnopqrstuvwxyz"), (1, 4, b"ABC"), (1, 5000, b"D"), (1, -1, b"_"), (2, 0, b"")]
    cut = spark.createDataFrame([(k, i, bytearray(b)) for k, i, b in rows] + [(1, 0, bytearray(b"abce"))], "k long, n long, b binary")
    got = sorted((r.k, r.n, bytes(r.b)) for r in C.packed_chunks(cut, "k", "n", "b").collect())
    assert got == [(1, -1, b"_"), (1, 0, b"abcdefghijklmnopqrstuvwxyz"), (1, 4, b"ABC"), (1, 5000, b"D"), (2, 0, b"")]
