import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from blackbar.llm import spelling as M

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(docs, every=97):
    n = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def model(docs, every=97):
    n = counted(docs, every)
    near = {w: [v for v in n if apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def found(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in df.collect())


def texts(n, seed=2):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdeéßÀ×") for _ in range(r.randint(3, 9))) for _ in range(60)]
    out = []
    for _ in range(n):
        ws = []
        for _ in range(60):
            w = pool[int(len(pool) * r.random() ** 3)]
            if r.random() < 0.3:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abé") + w[k:], w[:k] + r.choice("xyZ") + w[k + 1 :]])
            ws.append(w.capitalize() if r.random() < 0.2 else w)
        out.append(r.choice([" ", "1", "ğ", "\U0001f600"]).join(ws))
    return out


@pytest.mark.parametrize("node_words", [50_000, 4])
def test_words_forms_and_roots(llm, docs, node_words):
    rows = list(enumerate(texts(60)))
    got = found(M.spelling_variants(docs(rows), drop_every=7, node_words=node_words))
    assert got == model(rows, 7)
    assert any(r[1] and r[2] != r[1] for r in got)


def test_nulls_repeats_ties_and_long_words(llm, docs):
    long = "abcdefgh" * 40
    rows = [(None, "plane planes plane"), (1, "plane"), (1, "planes"), (1, "planes"), (2, None), (3, ""), (4, "placed " * 9)]
    rows += [(5, f"{long} " * 9 + f"{long}x " * 3), (6, "aaaaa " * 8 + "aaaab " * 4 + "aaabb " * 2), (7, "aaabb aaaac " * 4)]
    assert found(M.spelling_variants(docs(rows))) == model(rows)


def test_empty_table(docs):
    assert found(M.spelling_variants(docs([]))) == []
    assert found(M.spelling_variants(docs([(1, None)]))) == []


def test_long_texts_are_taken_in_spans():
    text = " ".join(texts(20)) + " " + "Ab" * 300
    whole = [r for span in M.runs_of(text) for r in span]
    assert [r for span in M.runs_of(text, 50) for r in span] == whole


def test_verifier_and_trie_against_every_pair():
    r = random.Random(4)
    words = list({"".join(r.choice("abc\xe9") for _ in range(r.randint(1, 6))).encode("latin-1") for _ in range(300)})
    words += [b"z" * 80, b"z" * 81, b"z" * 80 + b"y"]
    a, b = (x.ravel() for x in np.indices((len(words), len(words))))
    want = {(x, y) for x, v in enumerate(words) for y, w in enumerate(words) if apart(v, w)}
    good = M.Verifier(words).near(a, b)
    assert set(zip(a[good].tolist(), b[good].tolist())) == want
    counts = M.group_counts(words, 3)
    pairs = {p for q, w in M.Trie(counts, np.zeros(len(words))).search(counts, np.zeros(len(words))) for p in zip(q.tolist(), w.tolist())}
    assert want <= pairs


def test_query_equals_brute_force_counts(llm):
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.001"
    rows = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r.word: r for r in M.query(llm, sf).collect()}
    n = counted([(r["doc_id"], r["text"]) for r in rows])
    assert {w: r.n for w, r in got.items()} == n
    gaps = {}
    for w in n:
        for k in range(len(w)):
            gaps.setdefault((k, w[:k], w[k + 1 :]), []).append(w)
    near = {w: set() for w in n}
    for w in n:
        for k in range(len(w)):
            near[w] |= set(gaps[k, w[:k], w[k + 1 :]]) - {w}
            short = w[:k] + w[k + 1 :]
            if short in near:
                near[w].add(short)
                near[short].add(w)
    assert {w: r.n_near for w, r in got.items()} == {w: len(v) for w, v in near.items()}
