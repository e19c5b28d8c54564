import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from blackbar.llm import suffix_dedup as M


def model(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[j : j + length] for _, b in texts for j in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                gone[j : j + length] = True
        gone = gone[: len(b)]
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((str(i), len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def texts(seed):
    r = random.Random(seed)
    passage = ["".join(r.choice("abcdé \n") for _ in range(r.randint(30, 90))) for _ in range(4)]
    out = [None, "", "short", "ab" * 40, "x" * 100, "x" * 100 + "y"]
    for _ in range(40):
        parts = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 60))) for _ in range(3)]
        out.append(r.choice(passage).join(parts) if r.random() < 0.7 else parts[0])
    out += [out[10], out[12] + "tail", out[12]]
    return list(enumerate(out))


@pytest.mark.parametrize("hot", [20_000, 2])
def test_equals_brute_force(docs, hot):
    rows = texts(4)
    assert found(M.suffix_dedup(docs(rows), length=24, gram=8, hot_anchor=hot)) == model(rows, 24)


def test_production_length(docs):
    rows = texts(5)
    r = random.Random(7)
    long = "".join(r.choice("abcdefgh ") for _ in range(900))
    rows += [(100, long), (101, "start " + long[200:560] + " end"), (102, long[:199]), (103, long[700:] + "é" * 150)]
    assert found(M.suffix_dedup(docs(rows))) == model(rows, 200)


def test_interval_expansion_equals_brute_force():
    r = random.Random(1)
    for _ in range(150):
        length = r.choice([3, 4, 6, 10])
        strings = [bytes(r.choice(b"ab\0") for _ in range(r.randint(0, 25))) for _ in range(r.randint(1, 6))]
        group = np.array(sorted(r.randint(0, 2) for _ in strings))
        seen = Counter((g, s[j : j + length]) for g, s in zip(group, strings) for j in range(len(s) - length + 1))
        want = [
            (i, j) for i, s in enumerate(strings) for j in range(len(s) - length + 1) if seen[group[i], s[j : j + length]] > 1
        ]
        got = M.repeated_starts(strings, group, length)
        assert sorted(zip(*(x.tolist() for x in got))) == sorted(want)


def test_every_string_has_one_anchor():
    r = random.Random(2)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 80))) for _ in range(30)]
    text, code, first, last = M.anchors(strings, 12, 4)
    spots = sorted((t, j) for t, a, b in zip(text.tolist(), first.tolist(), last.tolist()) for j in range(a, b + 1))
    assert spots == sorted((i, j) for i, s in enumerate(strings) for j in range(len(s) - 11))
    by_string = {}
    for t, c, a, b in zip(text.tolist(), code.tolist(), first.tolist(), last.tolist()):
        for j in range(a, b + 1):
            assert by_string.setdefault(strings[t][j : j + 12], c) == c


def test_empty_and_repeated_rows(docs):
    assert M.suffix_dedup(docs([])).collect() == []
    rows = [(1, "q" * 150 + "r" * 150)] * 2 + [(None, "z" * 30), (2, "short"), (2, "short")]
    assert found(M.suffix_dedup(docs(rows))) == model(rows, 200)


def test_stage_keeps_all_documents(llm):
    r = random.Random(3)
    p = "".join(r.choice("abcdefghé ") for _ in range(400))
    rows = [(1, "one " + p, "en", "s", 9), (2, p + " two", "en", "s", 9), (3, None, "en", "s", 0), (4, "clean", "en", "s", 5)]
    df = llm.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = M.stage(llm, df, "")
    assert out.columns == df.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: ("one ", 4), 2: (" two", 4), 3: (None, None), 4: ("clean", 5)}


@pytest.mark.parametrize("hot", [20_000, 3])
def test_common_passages_and_repeated_lines_stay_one_row(docs, llm, hot):
    r = random.Random(11)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, line = word(240), word(60) + "\n"
    rows = [(i, word(90) + passage + word(80)) for i in range(60)] + [(100 + i, word(50) + line * 30) for i in range(20)]
    df = docs(rows)
    assert found(M.suffix_dedup(df, length=48, gram=12, hot_anchor=hot)) == model(rows, 48)
    strings = M._merged(
        llm.createDataFrame(
            [(1, [0, 9], 7, b"x" * 60), (1, [4], 8, b"y" * 9 + b"x" * 50), (1, [2], 9, b"z" * 50)],
            "anchor bigint, firsts array<bigint>, piece_key bigint, piece binary",
        )
    )
    for way in (M._solved, M._counted):
        got = {x.piece_key: [(s["from"], s["to"]) for s in x.spans] for x in way(strings, 48).collect()}
        merged = {k: sorted(v) for k, v in got.items()}
        # the first stands twice, its strings of x come back in the second, the third repeats in itself
        assert merged == {7: [(0, 12)], 8: [(9, 11)], 9: [(0, 2)]}


def test_stage_leaves_columns_of_any_name(llm):
    rows = [(1, "q" * 250, "mine", "too", 3, "four", 9), (2, "a " + "q" * 250, "mine", "too", 3, "four", 9)]
    df = llm.createDataFrame(
        rows, "doc_id bigint, text string, _sha string, sha string, copies int, Kept string, n_chars bigint"
    )
    out = M.stage(llm, df, "").collect()
    assert {r.text for r in out} == {"", "a "}
    assert {(r["_sha"], r.sha, r.copies, r.Kept) for r in out} == {("mine", "too", 3, "four")}
