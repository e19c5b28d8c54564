from collections import defaultdict

import duckdb

import check
from blackbar.llm import exact_dedup as M


def model(rows, sha):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(
        (str(i), str(best[t or ""]), len(groups[t or ""]), i == best[t or ""], sha(t)) for i, t in rows
    )


def found(df):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_groups(docs, words, sha):
    rows = list(enumerate(words(120)))
    assert found(M.exact_dedup(docs(rows))) == model(rows, sha)


def test_one_text_in_a_third_of_all_rows_is_salted(docs, words, sha):
    rows = list(enumerate(words(60) + ["again"] * 60))
    assert found(M.exact_dedup(docs(rows), rows_per_salt=4)) == model(rows, sha)


def test_nulls_repeated_rows_and_ties(docs, sha):
    rows = [(None, "a"), (1, "a"), (1, "a"), (2, None), (3, ""), (None, "b"), (None, "b"), (4, "c"), (4, "d")]
    assert found(M.exact_dedup(docs(rows))) == model(rows, sha)


def test_empty_table(docs):
    assert M.exact_dedup(docs([])).collect() == []


def test_stage_keeps_one_row_per_text(llm):
    rows = [(1, "a", "en", "s", 1), (2, "a", "en", "s", 1), (2, "a", "en", "s", 1), (3, None, "en", "s", 0), (4, "b", "en", "s", 1)]
    df = llm.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = M.stage(llm, df, "")
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]


def test_query_equals_sql(llm):
    sf = "/root/testdata/sf0.001"
    got = M.query(llm, sf)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = db.execute(M.ORACLE)
    names = [c[0] for c in want.description]
    assert check.rows_of(got.columns, [tuple(r) for r in got.collect()]) == check.rows_of(names, want.fetchall())
