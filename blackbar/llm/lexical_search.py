"""Ranked lexical search turned around: documents stream through an index over the queries' terms."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blackbar.llm.common import spread
from blackbar.llm.words import ragged, rows_of

TOP = 10
# Largest part of the index that a task holds, in postings (term, item).
BLOCK_POSTINGS = 1_000_000
# Bytes of a text taken apart at a time, scores (document, item) held at a time.
SPAN_BYTES = 1 << 20
CELLS = 2_000_000
# Tasks whose heaps are merged with one another before all are.
MERGE_TASKS = 1_000

# Every byte of a multi-byte character is at least 0x80.
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def terms_of(text: str | None, span: int = SPAN_BYTES) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of about ``span`` bytes; only A-Z are lower-cased."""
    data = (text or "").encode()
    start = 0
    while start < len(data):
        end = min(start + span, len(data))
        if end < len(data):
            gap = _GAP.search(data, end)
            end = gap.start() if gap else len(data)
        yield _TERM.findall(data[start:end].lower())
        start = end


def weight(total: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))


class Index:
    """An inverted index over items: of term t the items ``item[first[t]:first[t + 1]]``."""

    def __init__(self, postings: list[tuple[int, bytes]]):
        self.ids = sorted({i for i, _ in postings})
        place = {i: k for k, i in enumerate(self.ids)}
        by_term: dict[bytes, list[int]] = {}
        for i, term in postings:
            by_term.setdefault(term, []).append(place[i])
        self.number = {term: k for k, term in enumerate(by_term)}
        sizes = np.array([len(v) for v in by_term.values()], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.item = np.array([k for v in by_term.values() for k in v], np.int64)

    def counts(self, text: str | None) -> tuple[int, Counter]:
        """How many terms a text has, and how often each term of the index stands in it."""
        n, found = 0, Counter()
        for terms in terms_of(text):
            n += len(terms)
            found.update(filter(self.number.__contains__, terms))
        return n, found


def _statistics(shared):
    def run(batches):
        import pyarrow as pa

        index = shared.value
        df = np.zeros(len(index.number), np.int64)
        total = length = 0
        for _, text in rows_of(batches):
            n, found = index.counts(text)
            total += n > 0
            length += n
            if found:
                df[[index.number[t] for t in found]] += 1
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([-2, -1, *seen.tolist()], pa.int64()),
                pa.array([total, length, *df[seen].tolist()], pa.int64()),
            ],
            names=["term", "n"],
        )

    return run


def _searcher(shared, total: int, length: int, weights: np.ndarray, top: int):
    def run(batches):
        import pyarrow as pa

        index = shared.value
        items = len(index.ids)
        heaps: list[list] = [[] for _ in range(items)]
        floor = np.ones(items, np.int64)  # no lower score can enter the item's heap
        most = max(1, CELLS // items)
        docs: list = []
        rows: list[tuple[int, int, int, int]] = []

        def settle() -> None:
            d, t, tf, m = np.array(rows, np.int64).reshape(-1, 4).T
            gain = weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            fan = index.first[t + 1] - index.first[t]
            item = index.item[ragged(index.first[t], fan)]
            score = np.zeros(len(docs) * items, np.int64)
            np.add.at(score, np.repeat(d, fan) * items + item, np.repeat(gain, fan))
            score = score.reshape(len(docs), items)
            for a, i in zip(*(x.tolist() for x in np.nonzero(score >= floor))):
                doc, heap = docs[a], heaps[i]
                entry = (int(score[a, i]), doc is not None, -(doc or 0))
                if len(heap) < top:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
                if len(heap) == top:
                    floor[i] = max(1, heap[0][0])
            docs.clear()
            rows.clear()

        for doc, text in rows_of(batches):
            n, found = index.counts(text)
            if found:
                m = 10 + 90 * n * total // length
                rows.extend((len(docs), index.number[t], tf, m) for t, tf in found.items())
                docs.append(doc)
                if len(docs) >= most or len(rows) >= CELLS // 8:
                    settle()
        if docs:
            settle()
        out = [(index.ids[i], -e[2] if e[1] else None, e[0]) for i, heap in enumerate(heaps) for e in heap]
        columns = list(zip(*out)) if out else [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), pa.int64()) for c in columns], names=["item_no", "doc_id", "score"]
        )

    return run


def best_documents(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    top: int = TOP,
    block_postings: int = BLOCK_POSTINGS,
) -> DataFrame:
    """The ``top`` documents of every item: item_id, rank, doc_id, score.

    The items' terms make an inverted index, dealt by item into parts of about
    ``block_postings`` postings (one item's terms are never parted). A part is sent to all
    tasks; each streams its documents through it twice, first for the counts that weights need,
    then for scores, and keeps a heap of ``top`` documents per item. The heaps are merged in
    two steps. Documents are never shuffled.

    Null and empty texts have no terms: as documents they don't count and match nothing, as
    items they have no rows. Rows with one item id, null ids too, are one item with the terms
    of all. Every row of ``docs`` is a document, repeated ones take a rank each; ties go by
    ascending doc_id, null ids last. An empty table on either side gives no rows; columns not
    named are not read. A document's score with an item must stay below 2**63.
    """
    spark = docs.sparkSession
    texts = spread(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")))
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = F.translate(F.col(item_text_col), capitals, capitals.lower())
    # Ids may be null: nulls get a group key of their own.
    owned = items.select(
        F.col(item_col).cast("bigint").alias("item_id"),
        F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(r"([0-9a-z\x{80}-\x{10FFFF}]+)"), F.lit(1)))).alias("term"),
    ).distinct()
    parts = math.ceil(owned.count() / block_postings)
    found = None
    for part in range(parts):
        mine = owned.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        postings = mine.collect()  # one part of the index, of bounded size
        if not postings:
            continue
        keys = sorted({r.item_id for r in postings}, key=lambda i: (i is None, i or 0))
        number = {i: k for k, i in enumerate(keys)}
        index = Index([(number[r.item_id], r.term.encode()) for r in postings])
        shared = spark.sparkContext.broadcast(index)
        counts = dict(
            texts.mapInArrow(_statistics(shared), "term bigint, n bigint")
            .groupBy("term").agg(F.sum("n").cast("bigint")).collect()  # a row per term of the part
        )
        total, length = counts.get(-2, 0), counts.get(-1, 0)
        if not length:
            continue
        weights = np.array([weight(total, counts.get(t, 0)) for t in range(len(index.number))], np.int64)
        heaps = texts.mapInArrow(
            _searcher(shared, total, length, weights, top), "item_no bigint, doc_id bigint, score bigint"
        ).withColumn("merge", F.floor(F.spark_partition_id() / MERGE_TASKS))
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        for group in (["item_no", "merge"], ["item_no"]):
            rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
            heaps = heaps.withColumn("rank", rank).where(F.col("rank") <= top)
        known = F.array(*[F.lit(i).cast("bigint") for i in keys]) if len(keys) <= 10_000 else None
        if known is not None:
            named = heaps.withColumn("item_id", known[F.col("item_no").cast("int")])
        else:
            table = spark.createDataFrame(list(enumerate(keys)), "item_no bigint, item_id bigint")
            named = heaps.join(table, "item_no")
        named = named.select("item_id", "rank", "doc_id", "score")
        found = named if found is None else found.unionByName(named)
    if found is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return best_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = (
    "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    " '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
)
ORACLE = f"""
WITH words AS (SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS.format('text')}) AS term FROM benchmark),
hits AS (SELECT doc_id, term, count(*) AS tf FROM words
         WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
            FROM hits, whole GROUP BY term),
scores AS (SELECT item_id, doc_id,
                  sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
           FROM asked JOIN hits USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), whole
           GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""
