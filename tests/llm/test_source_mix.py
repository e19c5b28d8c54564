import random
from collections import defaultdict

import duckdb
import pytest

from blackbar.llm import source_mix as M

SCHEMA = "doc_id bigint, text string, source string, size string, target int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", None) for i, t, s in rows], SCHEMA)


def made(n, sources, seed=5):
    r = random.Random(seed)
    weights = [10 ** (k % 3) for k in range(len(sources))]
    return [
        (i, "w\t" * int(r.paretovariate(0.9)) + "end\n", r.choices(sources, weights)[0]) for i in range(n)
    ]


def goals(sizes):
    """Deal by weight, stop at twice the size, deal the rest again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    full, whole = set(), 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        rest = whole - sum(2 * sizes[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not above:
            return {s: 2.0 * sizes[s] if s in full else share[s] for s in names}
        full |= above


def check(spark, rows, **options):
    got = M.mix_sources(table(spark, rows), **options).collect()
    sizes, largest = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        n = len((t or "").split())
        sizes[s] += n
        largest[s] = max(largest[s], n)
    target = goals(sizes)
    assert len(got) == len(rows)
    source = {i: s for i, _, s in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        assert r.taken <= 2 * r.size and r.taken == r.size * r.copies
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1.2 * largest[s] + 0.02 * sizes[s]
    return sorted((tuple(r) for r in got), key=str)


def test_targets_and_words_taken(llm):
    rows = made(3000, ["a", "é", "Z", "b", None, "zz", ""])
    assert check(llm, rows) == check(llm, rows[::-1])


def test_one_source_has_most_rows_in_many_blocks(llm):
    rows = [(i, "one two three", "hot") for i in range(1500)] + [(2000 + i, "x " * i, f"s{i % 5}") for i in range(60)]
    assert check(llm, rows, block_rows=20) == check(llm, rows)


def test_all_sources_full_one_source_empty(llm):
    check(llm, [(1, "a b", "x"), (2, None, "y"), (3, "", None)])
    got = M.mix_sources(table(llm, [(1, None, "x"), (2, "", None)])).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_nulls_repeated_rows_and_empty_table(llm):
    rows = [(None, "a b c", "x")] * 4 + [(7, "q", None)] * 3
    got = M.mix_sources(table(llm, rows)).collect()
    assert len(got) == 7 and {r.source_size for r in got} == {12, 3}
    assert M.mix_sources(table(llm, [])).collect() == []


def test_sum_crosses_as_many_integers_as_expected(llm):
    rows = [(i, "w", "a") for i in range(997)] + [(1000 + i, "w " * 9, "b") for i in range(300)]
    got = M.mix_sources(table(llm, rows)).collect()
    for size in (1, 9):
        mine = [r for r in got if r.size == size]
        expected = mine[0].target / size
        assert abs(sum(r.copies for r in mine) - expected) < 1


def test_query_equals_sql(llm):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    result = db.execute(M.ORACLE)
    names = [c[0] for c in result.description]
    want = sorted(tuple(r[names.index(c)] for c in ("doc_id", "size", "source_size", "target", "copies", "taken"))
                  for r in result.fetchall())
    assert sorted(map(tuple, M.query(llm, sf).collect())) == want
