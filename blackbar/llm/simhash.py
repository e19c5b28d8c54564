"""SimHash fingerprints and their near-duplicate groups by a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blackbar.llm.common import connected, forest, own_name, spread, store
from blackbar.llm.words import Words, ragged

SHINGLE = 4
DISTANCE = 4
SEED = 42
FANOUT = 8
# A cell of more fingerprints is split into slices, and its fingerprints visit every slice.
CELL_LIMIT = 4096
_PAIRS = 1_000_000
_CHUNK = 300_000


def fingerprints(texts: list[str], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """uint64 fingerprints: a bit is set if it is set in over half of the shingles' XXH64."""
    from xxhash import xxh64_intdigest as xxh64

    words = Words([b" ".join(t.encode().lower().split()) for t in texts])
    n = np.diff(words.first)
    shingles = np.where(n >= shingle, n - shingle + 1, (n > 0).astype(np.int64))
    first = words.first[:-1]
    from_word = ragged(first, shingles)
    to_word = from_word + np.minimum(shingle, np.repeat(n, shingles)) - 1
    data = words.data
    hashes = np.array(
        [xxh64(data[a:b], seed) for a, b in zip(words.start[from_word].tolist(), words.end[to_word].tolist())],
        np.uint64,
    )
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(shingles)
    if len(some):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        begins = (np.cumsum(shingles) - shingles)[some]
        count = np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
        major = 2 * count > shingles[some][:, None]
        out[some] = np.packbits(major, axis=1).view(">u8").ravel()
    return out


def _fingerprint(shingle: int, seed: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from blackbar.llm.simhash import fingerprints
        from blackbar.llm.words import by_bytes, rows_of

        kinds = {"doc_id": pa.int64(), "digest": pa.binary()}
        for batch in batches:
            names = batch.schema.names[1:]
            for keys, texts in by_bytes(((keys, text) for text, *keys in rows_of([batch])), 600_000):
                found = fingerprints(texts, shingle, seed)
                columns = [pa.array(column, kinds[name]) for name, column in zip(names, zip(*keys))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found.view(np.int64))], names=[*names, "bits"])

    return run


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Fingerprints in Gray order below nodes that hold the bit pattern all below them share.

    ``codes`` lie in groups; only codes of one group are compared. A node's pattern is the AND
    of what is below it, its mask the bits in which nothing below differs. Differences to a
    query are counted once, at the highest node whose mask has the bit, and are summed on the
    way down; a node whose sum exceeds the distance is dropped with all that is below it.
    """

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        self.levels = [(codes, np.full(len(codes), ~np.uint64(0)), None, None)]
        low, high, count = codes, codes, sizes
        while True:
            nodes = -(-count // FANOUT)
            at = np.repeat(np.cumsum(count) - count, nodes)
            place = ragged(np.zeros(len(nodes), np.int64), nodes)
            begin = at + FANOUT * place
            length = np.minimum(FANOUT, np.repeat(count, nodes) - FANOUT * place)
            low, high = np.bitwise_and.reduceat(low, begin), np.bitwise_or.reduceat(high, begin)
            self.levels.append((low, ~(low ^ high), begin, length))
            count = nodes
            if (nodes <= 1).all():
                break

    def uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """Per level, the label that all leaves below a node have, or -1."""
        out, low, high = [label], label, label
        for _, _, begin, _ in self.levels[1:]:
            low, high = np.minimum.reduceat(low, begin), np.maximum.reduceat(high, begin)
            out.append(np.where(low == high, low, -1))
        return out

    def search(
        self, query: np.ndarray, root: np.ndarray, distance: int, label: np.ndarray, same: list[np.ndarray]
    ) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query number, leaf) within the distance whose labels differ."""
        q = np.arange(len(query))
        node = root
        top = len(self.levels) - 1
        low, mask, _, _ = self.levels[top]
        total = np.bitwise_count((query[q] ^ low[node]) & mask[node]).astype(np.int16)
        for level in range(top, -1, -1):
            keep = (total <= distance) & (same[level][node] != label[q])
            q, node, total = q[keep], node[keep], total[keep]
            if not level or not len(q):
                break
            _, above, begin, length = self.levels[level]
            n = length[node]
            child = ragged(begin[node], n)
            q, total, old = np.repeat(q, n), np.repeat(total, n), np.repeat(above[node], n)
            node = child
            low, mask, _, _ = self.levels[level - 1]
            total = total + np.bitwise_count((query[q] ^ low[node]) & mask[node] & ~old)
        return (q, node) if len(q) else (q[:0], node[:0])


def link_cells(cell: np.ndarray, code: np.ndarray, role: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (code, code) of the links inside each cell.

    role 0: a fingerprint of the index and a query; 1: of the index only; 2: a query only.
    """
    order = np.lexsort((gray_rank(code), role == 2, cell))
    cell, code, role = cell[order], code[order], role[order]
    label = np.arange(len(code))
    leaf = np.flatnonzero(role != 2)
    if len(leaf) < 1:
        return code[:0], code[:0]
    _, group, sizes = np.unique(cell[leaf], return_inverse=True, return_counts=True)
    index = GrayIndex(code[leaf], sizes)
    names = cell[leaf][np.cumsum(sizes) - sizes]
    query = np.flatnonzero(role != 1)
    root = np.searchsorted(names, cell[query])
    inside = (root < len(names)) & (names[np.minimum(root, len(names) - 1)] == cell[query])
    query, root = query[inside], root[inside]
    big = np.flatnonzero(sizes[root] > 1) if (role == 0).all() else np.arange(len(query))
    query, root = query[big], root[big]
    cost = np.cumsum(sizes[root])
    at = 0
    while at < len(query):
        to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + _PAIRS)))
        some = query[at:to]
        q, found = index.search(code[some], root[at:to], distance, label[some], index.uniform(label[leaf]))
        if len(q):
            nodes, roots = forest(label[some][q], label[leaf[found]])
            step = np.arange(len(label))
            step[nodes] = roots
            label = step[label]
        at = to
    other = np.flatnonzero(label != np.arange(len(label)))
    return code[other], code[label[other]]


def _linker(distance: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from blackbar.llm import simhash as S

        held: list[tuple] = []
        size = 0

        def flush(last: bool):
            nonlocal held, size
            cell, code, role = (np.concatenate(x) for x in zip(*held))
            cut = len(cell) if last else int(np.searchsorted(cell, cell[-1]))
            held = [(cell[cut:], code[cut:], role[cut:])]
            size = len(cell) - cut
            if cut:
                a, b = S.link_cells(cell[:cut], code[:cut].view(np.uint64), role[:cut], distance)
                return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            size += batch.num_rows
            if size >= S._CHUNK and (out := flush(False)) is not None:
                yield out
        if size and (out := flush(True)) is not None:
            yield out

    return run


def link_fingerprints(codes: DataFrame, distance: int = DISTANCE, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """Links (a, b) that connect all distinct bigint ``bits`` within ``distance`` of each other.

    Of distance + 1 blocks of bits, two such codes share one, so every code enters one cell per
    block, and each cell is searched through its Gray-order index. Cells over ``cell_limit`` codes are dealt out in
    slices; their codes are in one slice of the index and search all of them.
    """
    blocks = distance + 1
    edge = [round(i * 64 / blocks) for i in range(blocks + 1)]
    cells = F.explode(F.array(*[
        F.xxhash64(F.lit(i), F.shiftrightunsigned("bits", a).bitwiseAND(F.lit((1 << (b - a)) - 1)))
        for i, (a, b) in enumerate(zip(edge, edge[1:]))
    ]))
    keyed = codes.select("bits", cells.alias("cell"))
    large = store(keyed.groupBy("cell").count().where(F.col("count") > cell_limit), "cells")
    sliced = keyed.join(large, "cell", "left").withColumn(
        "slices", F.coalesce(F.ceil(F.col("count") / cell_limit), F.lit(1)).cast("int")
    )
    own = F.pmod(F.xxhash64("bits"), F.col("slices")).cast("int")
    rows = sliced.select("bits", "cell", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")).select(
        F.xxhash64("cell", "slice").alias("cell"),
        "bits",
        F.when(F.col("own") == F.col("slice"), 0).otherwise(2).cast("int").alias("role"),
    )
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_linker(distance), "a bigint, b bigint")


def _placed(found: DataFrame, low: Column, distance: int, cell_limit: int) -> tuple[DataFrame, DataFrame]:
    """Of fingerprinted rows (bits, component) of each fingerprint, and (component, low), the least ``low`` in each."""
    codes = store(found.groupBy("bits").agg(F.min(low).alias("low")), "codes")
    root = connected(link_fingerprints(codes.select("bits"), distance, cell_limit))
    placed = codes.join(root, codes["bits"] == root["node"], "left").select(
        "bits", "low", F.coalesce("component", "bits").alias("component")
    )
    return placed.drop("low"), store(placed.groupBy("component").agg(F.min("low").alias("low")), "lowest")


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
    seed: int = SEED,
    cell_limit: int = CELL_LIMIT,
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Words are lower-cased in A-Z only; texts of fewer words than a shingle are one shingle;
    texts without words, empty and null ones have fingerprint zero, which is linked like any
    other. Equal fingerprints are one node, so copies never make pairs. component_id is the
    smallest id reachable over links of at most ``distance`` bits, null if the group has no
    ids. Repeated rows are repeated in the result; an empty table gives no rows. Only the two
    named columns are read.
    """
    rows = spread(docs.select(F.col(text_col), F.col(id_col).cast("bigint").alias("doc_id")))
    found = store(rows.mapInArrow(_fingerprint(shingle, seed), "doc_id bigint, bits bigint"), "fingerprints")
    placed, lowest = _placed(found, F.col("doc_id"), distance, cell_limit)
    groups = store(placed.join(lowest, "component").select("bits", F.col("low").alias("component_id")), "groups")
    return found.join(groups, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: the first by id, nulls last, then by the SHA-256 of the text.

    A row is its id and text, so rows without an id and unlike texts under one id stand for
    themselves. Null texts count as empty; of rows with equal ids and texts one stays.
    """
    number = F.col("doc_id").cast("bigint")
    digest = F.unhex(F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256))
    rows = spread(docs.select("text", number.alias("doc_id"), digest.alias("digest")))
    found = store(
        rows.mapInArrow(_fingerprint(SHINGLE, SEED), "doc_id bigint, digest binary, bits bigint"), "fingerprints"
    )
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    _, first = _placed(found, order, DISTANCE, CELL_LIMIT)

    def key(number: Column, digest: Column) -> Column:
        return F.sha2(F.concat(digest, F.encode(F.coalesce(number.cast("string"), F.lit("")), "UTF-8")), 256)

    row = own_name(docs, "row")
    kept = first.select(key(F.col("low.doc_id"), F.col("low.digest")).alias(row))
    marked = docs.withColumn(row, key(number, digest))
    return marked.join(kept, row, "left_semi").dropDuplicates([row]).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
