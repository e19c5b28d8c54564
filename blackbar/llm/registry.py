"""The registered queries of the training-data operators, and those of them that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from blackbar.llm import (
    embedding_dedup,
    exact_dedup,
    lexical_search,
    license_scan,
    packing,
    sentence_pieces,
    simhash,
    source_mix,
    spelling,
    suffix_dedup,
    suffix_tree,
    toxicity,
    url_filter,
)
from blackbar.llm.common import ship


def _shipped(query: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_packing": _shipped(packing.query),
    "op2_lm_score": _shipped(suffix_tree.query),
    "op3_toxicity": _shipped(toxicity.query),
    "op4_embedding_neardup": _shipped(embedding_dedup.query),
    "op5_simhash_neardup": _shipped(simhash.query),
    "op6_url_filter": _shipped(url_filter.query),
    "op7_suffix_dedup": _shipped(suffix_dedup.query),
    "op8_license_scan": license_scan.query,
    "op9_exact_dedup": exact_dedup.query,
    "op10_sentence_pieces": _shipped(sentence_pieces.query),
    "op11_lexical_search": _shipped(lexical_search.query),
    "op12_source_mix": source_mix.query,
    "op13_spelling": _shipped(spelling.query),
}

ORACLE = {
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op11_lexical_search": lexical_search.ORACLE,
    "op12_source_mix": source_mix.ORACLE,
}
