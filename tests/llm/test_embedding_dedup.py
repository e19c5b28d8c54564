import math

import numpy as np

from blackbar.llm import embedding_dedup as M


def vectors(seed=1, n=400, dims=16):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dims)).astype(np.float32)
    for i in range(0, n, 3):  # groups of near copies, one of them large
        x[i] = x[0 if i < n // 2 else i - 1] + 0.15 * r.standard_normal(dims) / math.sqrt(dims) * 4 * (i % 2 + 0.3)
    x[10] = x[11]
    x[12] = 3 * x[11]
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


def model(rows, cosine):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= cosine
    np.fill_diagonal(link, False)
    label = np.arange(len(ids))
    while True:
        new = np.minimum(label, np.where(link, label[None, :], len(ids)).min(1))
        if (new == label).all():
            break
        label = new
    return {i: (int(k), ids[a]) for i, k, a in zip(ids, link.sum(1), label)}


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, n_links int")


def test_links_equal_brute_force(llm):
    rows = vectors()
    want = model(rows, 0.95)
    for options in ({}, {"shards": 3, "beam": 2, "query_block": 150, "shard_vectors": 60}):
        got = {r.vec_id: r for r in M.embedding_groups(frame(llm, rows), **options).collect()}
        links = sum(k for k, _ in want.values())
        found = sum(r.n_links for r in got.values())
        assert 0.98 * links <= found <= links
        assert all(r.n_links <= want[i][0] for i, r in got.items())
        assert np.mean([got[i].component_id == c for i, (_, c) in want.items()]) > 0.98
        assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_graph_recall_and_widening():
    r = np.random.default_rng(2)
    x = r.standard_normal((3000, 24)).astype(np.float32)
    x[:700] = x[0] + 0.1 * r.standard_normal((700, 24)) / 5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = M.Graph(x)
    exact = x @ x.T >= 0.95
    width = M.audited_width(g, x[::20], 0.95, 8, 0.99)
    a, b = g.within(x, 0.95, width)
    assert len(a) == len(set(zip(a.tolist(), b.tolist())))
    assert exact[a, b].all() and exact[a, b].sum() >= 0.97 * exact.sum()


def test_unusable_vectors_link_with_nothing(llm):
    one = [1.0, 2.0, 3.0]
    rows = [
        (1, one), (2, one), (2, one), (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 3.0]),
        (6, [float("nan"), 2.0, 3.0]), (7, [float("inf"), 2.0, 3.0]), (8, []), (9, [1.0, 2.0]), (None, one),
        (11, [1e38, 2e38, 3e38]), (12, [1e-38, 2e-38, 3e-38]),
    ]
    got = M.embedding_groups(frame(llm, rows)).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert by[1] == (4, 1, True) and by[2] == by[11][:1] + (1, False) and by[12][1] == 1
    for i in (3, 4, 5, 6, 7, 8, 9):
        assert by[i] == (0, i, True)
    assert by[None] == (0, None, True)


def test_empty_table(llm):
    assert M.embedding_groups(frame(llm, [])).collect() == []


def test_any_two_shards_meet_once(llm):
    r = np.random.default_rng(6)
    rows = vectors(seed=7, n=150)
    rows = [(i, [c + 1e-4 * r.standard_normal() for c in v]) for i, v in rows] + [(200 + i, v) for i, v in rows[:5]]
    want = model(rows, 0.9)
    for options in ({"shards": 1}, {"shards": 2, "query_block": 40}, {"shards": 5}, {"shards": 6, "query_block": 60}):
        got = M.embedding_groups(frame(llm, rows), cosine=0.9, recall=0.9999999, **options).collect()
        assert {x.vec_id: (x.n_links, x.component_id) for x in got} == want


def test_few_vectors_are_compared_and_near_ones_found():
    r = np.random.default_rng(8)
    x = r.standard_normal((20000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = r.standard_normal((1000, 32))
    away -= (away * x[:1000]).sum(1, keepdims=True) * x[:1000]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    x[-1000:] = 0.952 * x[:1000] + math.sqrt(1 - 0.952**2) * away
    x = x.astype(np.float32)
    g = M.Graph(x)
    width = g.tables(0.95, 0.99)
    looked = sum(len(a) for a, _, _ in g.pairs(x[:2000], -2.0, width))
    assert looked < 0.05 * 2000 * len(x)
    a, b = g.within(x[:1000], 0.95, width)
    assert len(a) == len(set(zip(a.tolist(), b.tolist())))
    assert (b == a + 19000).sum() >= 980


def test_crowds_are_found_whole():
    r = np.random.default_rng(9)
    x = r.standard_normal((6000, 16)).astype(np.float32)
    x[:3000] = x[0] + 0.02 * r.standard_normal((3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = M.Graph(x)
    exact = x @ x.T >= 0.95
    for width in (g.tables(0.95, 0.999), M.TABLES):
        a, b = g.within(x, 0.95 - M.OFF, width)
        assert len(a) == len(np.unique(a * len(x) + b))
        found = np.zeros(exact.shape, bool)
        found[a, b] = True
        assert (found & exact).sum() >= 0.998 * exact.sum() and (exact[:3000] <= found[:3000])[:, :3000].mean() > 0.9999


def test_negative_zero_is_zero(llm):
    rows = [(1, [0.0, 1.0, 2.0]), (2, [-0.0, 1.0, 2.0]), (3, [1.0, -0.0, 0.0]), (4, [1.0, 0.0, -0.0]), (5, [0.0, 0.0, -0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in M.embedding_groups(frame(llm, rows)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5)}
