import hashlib
import re

import numpy as np
import xxhash

from blackbar.llm import simhash as M


def fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def components(codes, distance):
    ids = sorted(codes)
    x = np.array([codes[i] for i in ids], np.uint64)
    label = np.arange(len(ids))
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= distance
    while True:
        new = np.where(near, label[None, :], len(ids)).min(1)
        if (new == label).all():
            return {i: ids[a] for i, a in zip(ids, label)}
        label = new


def test_groups_equal_brute_force(docs, words):
    rows = list(enumerate(words(250, length=30)))
    codes = {i: fingerprint(t) for i, t in rows}
    for limit in (4096, 2):  # the second splits almost every cell
        got = M.simhash_groups(docs(rows), cell_limit=limit).collect()
        assert {r.doc_id: int(r.fingerprint, 16) for r in got} == codes
        assert {r.doc_id: r.component_id for r in got} == components(codes, 4)


def test_index_finds_all_links_of_dense_groups():
    r = np.random.default_rng(1)
    centre = r.integers(0, 2**63, 3).astype(np.uint64)
    code = np.unique(np.concatenate([c ^ (np.uint64(1) << r.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 300).astype(np.uint64)) for c in centre]))
    for distance in (1, 2, 4):
        a, b = M.link_cells(np.zeros(len(code), np.int64), code, np.zeros(len(code), np.int64), distance)
        want = components(dict(enumerate(code.tolist())), distance)
        assert len(a) == len(code) - len(set(want.values()))


def test_gray_rank_orders_by_gray_code():
    rank = np.arange(64, dtype=np.uint64)
    assert M.gray_rank(rank ^ (rank >> np.uint64(1))).tolist() == rank.tolist()


def test_empty_null_and_repeated(docs):
    assert M.simhash_groups(docs([])).collect() == []
    got = M.simhash_groups(docs([(5, None), (3, ""), (3, ""), (None, " "), (9, "a b c d e")])).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got) == [("3", 3), ("3", 3), ("5", 3), ("9", 9), ("None", 3)]


def test_stage_keeps_one_of_each_group(llm):
    rows = [(i, t, "en", "s", 1) for i, t in [(2, "a b c d"), (1, "a b c d"), (1, "a b c d"), (3, "x y z w v")]]
    df = llm.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = M.stage(llm, df, "")
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def _stage(llm, rows):
    df = llm.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return sorted(((r.doc_id, r.text) for r in M.stage(llm, df, "").collect()), key=str)


def test_stage_keeps_unlike_texts_without_ids(llm):
    unlike = ["a b c d e", "k l m n o", "p q r s t"]
    assert _stage(llm, [(None, t) for t in unlike] + [(None, unlike[0])]) == [(None, t) for t in unlike]
    # a row without an id yields to one that has an id
    assert _stage(llm, [(None, unlike[0]), (None, unlike[1]), (7, unlike[0])]) == [(7, unlike[0]), (None, unlike[1])]


def test_stage_keeps_unlike_texts_of_one_id(llm):
    unlike = ["a b c d e", "k l m n o"]
    assert _stage(llm, [(1, t) for t in unlike] + [(2, unlike[0])]) == [(1, t) for t in unlike]


def test_stage_picks_by_a_total_order(llm):
    near = ["a b c d e", "A b c d e"]  # one fingerprint
    first = min(near, key=lambda t: hashlib.sha256(t.encode()).digest())
    for number in (1, None):
        for rows in (near, near[::-1]):
            assert _stage(llm, [(number, t) for t in rows]) == [(number, first)]
