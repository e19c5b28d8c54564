import math
import re
from collections import Counter

import duckdb

from blackbar.llm import lexical_search as M

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "item_id bigint, text string, doc_id int, score string"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def model(docs, items, top=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    total, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, c in counts:
            m = 10 + 90 * sum(c.values()) * total // length
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in wanted
                if c[t]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [
            (item, k + 1, None if s[1] else s[2], -s[0]) for k, s in enumerate(sorted(scored)[:top])
        ]
    return sorted(out, key=str)


def found(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in rows], SCHEMA)


def test_ranks(llm, docs, words):
    texts = words(200)
    rows = list(enumerate(texts))
    asked = [(i, texts[i * 7]) for i in range(20)] + [(20, "ÉCOLE École 'x1' nowhere"), (21, None), (22, "")]
    assert found(M.best_documents(docs(rows), items_of(llm, asked))) == model(rows, asked)


def test_parts_of_the_index_and_small_steps(llm, docs, words, monkeypatch):
    monkeypatch.setattr(M, "MERGE_TASKS", 2)
    texts = words(80, seed=3)
    rows = list(enumerate(texts))
    asked = [(i, texts[i]) for i in range(12)]
    assert found(M.best_documents(docs(rows), items_of(llm, asked), block_postings=40)) == model(rows, asked)


def test_nulls_ties_and_repeated_rows(llm, docs):
    rows = [(None, "a b"), (3, "a b"), (3, "a b"), (1, "a b"), (2, None), (4, ""), (5, "c"), (None, "A-B")]
    rows += [(k, "z") for k in range(10, 40)]
    asked = [(1, "a b"), (1, "c"), (None, "b"), (None, "c"), (2, "z z"), (3, None)]
    assert found(M.best_documents(docs(rows), items_of(llm, asked))) == model(rows, asked)


def test_empty_tables(llm, docs):
    assert found(M.best_documents(docs([]), items_of(llm, [(1, "a")]))) == []
    assert found(M.best_documents(docs([(1, "a")]), items_of(llm, []))) == []
    assert found(M.best_documents(docs([(1, None)]), items_of(llm, [(1, "a")]))) == []


def test_long_texts_are_taken_in_spans(words):
    text = " ".join(t for t in words(60) if t) + " " + "x" * 5000 + ",Ü"
    assert [t.decode() for span in M.terms_of(text, 64) for t in span] == terms(text)


def test_query_equals_sql(llm):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    assert found(M.query(llm, sf)) == sorted(db.execute(M.ORACLE).fetchall(), key=str)
