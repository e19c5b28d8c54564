import random

import numpy as np
import pytest

from blackbar.llm import toxicity as M

BAD = ["foulword", "nastiness", "grrrbad"]


def table(n, seed):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(n):
        w = [r.choice(pool) for _ in range(r.randint(5, 120))]
        toxic = int(r.random() < 0.3)
        if toxic:
            w[r.randrange(len(w))] = r.choice(BAD) + r.choice(["", ",", "!"])
        rows.append((i, " ".join(w), toxic))
    return rows


def test_gradients_equal_differences():
    r = np.random.default_rng(0)
    net = M.Network(1)
    for k in net.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64))
    x = r.standard_normal((6, 2 * M.DIM))
    index = r.integers(0, 6, (5, M.WINDOW))
    index[1, 10:] = -1
    index[2, :] = -1
    y, weight = np.array([0, 1, 1, 0, 1.0]), np.array([1, 2, 1, 3, 1.0])

    def loss():
        z = net.pool(net.states(x, index), index)[0].astype(float)
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() / len(y))

    g, dx = net.gradients(x, index, y, weight)
    eps = 1e-2
    for name in net.NAMES[2:]:
        p = getattr(net, name)
        at = tuple(r.integers(0, s) for s in p.shape)
        old = p[at]
        p[at] = old + eps
        up = loss()
        p[at] = old - eps
        down = loss()
        p[at] = old
        assert g[name][at] == pytest.approx((up - down) / (2 * eps), abs=2e-3), name
    old = x[3, 2]
    x[3, 2] = old + eps
    up = loss()
    x[3, 2] = old - eps
    down = loss()
    x[3, 2] = old
    assert dx[3, 2] == pytest.approx((up - down) / (2 * eps), abs=2e-3)


def test_windows_cover_every_word():
    texts = ["", "one", " ".join(str(k) for k in range(31)), " ".join(f"v{k}" for k in range(200)), "!!! ...", "é ß"]
    batch = M.prepare(texts)
    for i, t in enumerate(texts):
        rows = batch.index[batch.text == i]
        assert len(rows) >= 1
        inside = set(rows[rows >= 0].tolist())
        assert len(inside) == len({w for w in t.translate({ord(c): " " for c in "!."}).split()})
        for a, b in zip(rows, rows[1:]):
            assert set(a[M.STRIDE :]) & set(b[: M.WINDOW - M.STRIDE]) >= {a[-1]}


def test_held_out_texts_are_told_apart(llm):
    rows = table(900, 2)
    docs = llm.createDataFrame([(i, t, 7.0) for i, t, _ in rows], "doc_id bigint, text string, score double")
    labels = llm.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    truth = {i: y for i, _, y in rows}
    got = [r for r in M.toxicity(docs, labels).collect() if r.held_out]
    assert len(got) > 150
    assert np.mean([r.predicted == truth[r.doc_id] for r in got]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_held_out_labels_change_nothing(llm):
    rows = table(200, 4)
    docs = llm.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    held = {r[0] for r in docs.where(M.crc_of(M.F.col("doc_id")) % 4 == 2).select("doc_id").collect()}
    out = []
    for flip in (False, True):
        labels = llm.createDataFrame([(i, 1 - y if flip and i in held else y) for i, _, y in rows], "doc_id bigint, toxic int")
        out.append(sorted((r.doc_id, r.score) for r in M.toxicity(docs, labels, epochs=2).collect()))
    assert out[0] == out[1]


def test_nulls_empty_tables_and_repeated_rows(llm):
    schema, kinds = "doc_id bigint, text string", "doc_id bigint, toxic int"
    none = llm.createDataFrame([], kinds)
    assert M.toxicity(llm.createDataFrame([], schema), none).collect() == []
    docs = llm.createDataFrame([(None, "a b"), (1, None), (1, None), (2, ""), (3, "x " * 50_000)], schema)
    labels = llm.createDataFrame([(1, None), (None, 1), (2, 5), (3, 0)], kinds)
    for known in (none, labels):
        got = M.toxicity(docs, known).collect()
        assert len(got) == 5 and all(r.predicted == 0 for r in got)


def test_stage_rejects_toxic_documents(llm):
    rows = table(400, 6)
    docs = llm.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = llm.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")

    class Session:  # the stage reads its labels from the folder it is given
        class read:
            @staticmethod
            def parquet(path):
                return labels

    kept = M.stage(Session, docs, "")
    rejected = {r.doc_id for r in M.toxicity(docs, labels).collect() if r.predicted}
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _ in rows} - rejected


def test_a_passage_is_rejected_at_every_offset():
    # a network that scores a window by how many of its 32 words are the one bad word
    net = M.Network(1)
    bad = M.prepare(["vile"])
    for k in net.NAMES:
        getattr(net, k)[...] = 0
    net.words[bad.bucket[0], 0] = 1
    net.wx[:, 0, 2 * M.HIDDEN] = 20
    net.wb[:, M.HIDDEN : 2 * M.HIDDEN] = -20
    for length in range(10, 18):
        # half of what the pooled states sum to between one bad word less and all of them
        net.out[[0, M.HIDDEN]] = 50
        net.outb[:] = -100 * (length - 0.5) / M.WINDOW
        texts = []
        for before in range(0, 100):
            words = [f"w{k}" for k in range(150)]
            words[before:before] = ["vile"] * length
            texts.append(" ".join(words))
        assert (M.score_texts(net, texts) >= M.THRESHOLD).all(), length
        short = [t.replace("vile ", "", 1) for t in texts]
        assert (M.score_texts(net, short) < M.THRESHOLD).all(), length


def test_scores_equal_those_of_all_windows():
    r = random.Random(3)
    net = M.Network(5)
    texts = [" ".join(f"w{r.randrange(300)}" for _ in range(n)) for n in (0, 1, 31, 32, 33, 5, 64, 700, 0, 3000, 32, 40_000, 7)]
    for some in (texts, texts[:3], texts[3:4], [""], [], texts[::-1]):
        want = []
        for t in some:
            windows = M.prepare([t], 1)
            assert len(windows.index) == max(1, len(t.split()) - 31)
            want.append(1 / (1 + np.exp(-net.logits(windows).max())))
        assert M.score_texts(net, some) == pytest.approx(want, abs=1e-5)


def test_only_full_windows_of_one_text_are_scored(monkeypatch):
    net, lanes = M.Network(5), []
    texts = [" ".join(f"w{(k * k) % 97}" for k in range(n)) for n in (40, 31, 700, 33, 1200, 0, 32, 64, 40, 45)]
    full = sum(max(0, len(t.split()) - 31) for t in texts)
    exp = np.exp

    def counted(x, out=None, **rest):
        if np.ndim(x) == 2 and len(x) == M.WINDOW:  # the attention weights, a column for each window
            lanes.append(x.shape[1])
        return exp(x, out, **rest)

    monkeypatch.setattr(M.np, "exp", counted)
    M.score_texts(net, texts * 20)
    short = sum(len(t.split()) < 32 for t in texts) * 20
    # one window for each start in a text, a short text as one, and few to even out runs of unlike length
    assert full * 20 + short <= sum(lanes) < 1.1 * (full * 20 + short)
