import numpy as np

import __spark_entry__ as E
import corpus_pipeline as P
from blackbar.llm import exact_dedup, packing, simhash, suffix_dedup, toxicity
from blackbar.llm.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [f for _, f in P.STAGES] == [toxicity.stage, exact_dedup.stage, simhash.stage, suffix_dedup.stage, packing.stage]


def test_registered_queries():
    assert [k.split("_")[0] for k in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(ORACLE) <= set(QUERIES) <= set(E.queries()) and "pipeline" in E.queries()


def test_run_equals_its_stages(llm):
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    total = docs.count()
    sizes = []
    for name, stage in P.STAGES:
        docs = stage(llm, docs, SF).cache()
        sizes.append(docs.count())
        if stage is not packing.stage:
            assert docs.columns == columns, name
    assert total >= sizes[0] >= sizes[1] >= sizes[2] == sizes[3]
    kept = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    out = P.run(llm, SF)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == kept
    assert out.selectExpr("sum(length)").first() == docs.selectExpr("sum(length)").first()


CLASHING = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(
    f"{c} string"
    for c in ("_score", "score", "kept_id", "text_sha256", "sha", "digest", "id", "_row", "row", "_sha", "_kept", "kept", "_copies")
)


def clashing_rows():
    same = "these words are said again and again in this text " * 3
    texts = [(1, same), (2, same), (2, same), (None, "a row without an id"), (None, None), (3, None), (4, "")]
    return [(i, t, "en", "s", len(t or ""), *(f"c{k}" for k in range(13))) for i, t in texts]


def test_filtering_stages_with_nulls_and_clashing_names(llm):
    df = llm.createDataFrame(clashing_rows(), CLASHING)
    for stage in (exact_dedup.stage, simhash.stage, suffix_dedup.stage):
        out = stage(llm, df, SF)
        assert out.columns == df.columns
        rows = out.collect()
        assert rows and all(tuple(r)[5:] == tuple(f"c{k}" for k in range(13)) for r in rows), stage
    kept = exact_dedup.stage(llm, df, SF).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted(
        [(2, clashing_rows()[0][1]), (0, "a row without an id"), (4, "")]
    )


def test_filtering_stages_of_empty_tables(llm):
    df = llm.createDataFrame([], CLASHING)
    for stage in (exact_dedup.stage, simhash.stage, suffix_dedup.stage):
        out = stage(llm, df, SF)
        assert out.columns == df.columns and out.collect() == []


def test_scores_beside_columns_of_that_name(llm):
    net = toxicity.train(["vile words here", "kind words here"] * 4, np.array([1, 0] * 4), 1)
    out = toxicity.with_score(llm.createDataFrame(clashing_rows(), CLASHING), "text", net)
    assert out.columns[-1] == "score_" and len(out.columns) == 19
    assert all(r["score"] == "c1" and r["_score"] == "c0" and 0 <= r["score_"] <= 1 for r in out.collect())
