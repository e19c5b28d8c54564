"""Near-duplicate vectors by graphs of vectors and the hash buckets that hold them, one per shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from blackbar.llm.common import connected, forest, store
from blackbar.llm.words import ragged

COSINE = 0.95
SHARDS = 8
SHARD_VECTORS = 100_000
QUERY_BLOCK = 1_000_000
BEAM = 32
# A task's sample of queries is compared with all vectors of the shard; beams widen until this holds.
AUDIT_QUERIES, AUDIT_RECALL = 256, 0.99
# Buckets have this many bits at most. Beams over so many tables are the whole shard.
BITS, TABLES = 18, 512
# Single precision is off by less than this.
OFF = 1e-5
# Queries searched at once; a query with more candidates is compared with those of all its like in one product,
# of so many cosines at once; pairs compared one by one at once.
_QUERIES, _CROWD, _PRODUCT, _PAIRS = 2048, 1000, 4_000_000, 100_000


class Graph:
    """Unit vectors, each linked to the buckets that hold it: one in every table, by the sides of random planes it is on.

    Two vectors at an angle are on one side of a plane with probability 1 - angle / pi, whatever the vectors are like, so
    ``width`` tables of b bits miss a pair with probability (1 - (1 - angle / pi) ** b) ** width.
    """

    def __init__(self, x: np.ndarray, seed: int = 5):
        self.x = np.ascontiguousarray(x, np.float32)
        self.seed = seed
        self.bits = min(BITS, max(1, len(x).bit_length()))
        self.planes = np.zeros((x.shape[1], 0), np.float32)
        # of each table, the vectors by bucket, and where the buckets begin
        self.order = np.zeros((0, len(x)), np.int32)
        self.start = np.zeros((0, (1 << self.bits) + 1), np.int32)

    def tables(self, cosine: float, recall: float) -> int:
        """How many tables miss a pair at ``cosine`` with probability 1 - ``recall`` at most."""
        angle = np.arccos(np.clip(cosine, -1.0, 1.0))
        both = (1 - angle / np.pi) ** self.bits
        return TABLES if both <= 0 else 1 if both >= 1 else min(TABLES, int(np.ceil(np.log(1 - recall) / np.log1p(-both))))

    def _keys(self, q: np.ndarray, width: int, first: int = 0) -> np.ndarray:
        side = q @ self.planes[:, first * self.bits : width * self.bits] > 0
        powers = (1 << np.arange(self.bits)).astype(np.float32)
        return (side.reshape(len(q), width - first, self.bits).astype(np.float32) @ powers).astype(np.int64)

    def _widen(self, width: int) -> None:
        old = len(self.order)
        if width <= old:
            return
        dims = self.x.shape[1]
        new = [np.random.default_rng([self.seed, t]).standard_normal((dims, self.bits)).astype(np.float32) for t in range(old, width)]
        self.planes = np.concatenate([self.planes, *new], 1)
        key = np.concatenate([
            self._keys(self.x[at : at + _QUERIES], width, old).astype(np.int32) for at in range(0, len(self.x), _QUERIES)
        ] or [np.zeros((0, width - old), np.int32)])
        order = np.argsort(key, axis=0, kind="stable").T.astype(np.int32)
        start = np.zeros((width - old, (1 << self.bits) + 1), np.int32)
        for t in range(width - old):
            np.cumsum(np.bincount(key[:, t], minlength=1 << self.bits), out=start[t, 1:])
        self.order, self.start = np.concatenate([self.order, order]), np.concatenate([self.start, start])

    def pairs(self, q: np.ndarray, cosine: float, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, vector, cosine) of what the queries' buckets in ``width`` tables hold at ``cosine`` or nearer, each once."""
        n = len(self.x)
        if not n or not len(q):
            return
        if width >= TABLES:
            yield from self._product(q, np.arange(len(q)), None, cosine)
            return
        self._widen(width)
        # queries that are alike together
        like = np.argsort(self._keys(q, 1)[:, 0], kind="stable")
        table = np.arange(width)
        for at in range(0, len(q), _QUERIES):
            rows = like[at : at + _QUERIES]
            key = self._keys(q[rows], width)
            low = self.start[table, key].astype(np.int64)
            size = self.start[table, key + 1] - low
            low += table * n
            crowd = size.sum(1) > _CROWD
            if crowd.any():
                some = np.zeros(n, bool)
                for t in range(width):
                    begin, first = np.unique(low[crowd, t], return_index=True)
                    some[self.order.ravel()[ragged(begin, size[crowd, t][first])]] = True
                yield from self._product(q, rows[crowd], np.flatnonzero(some) if some.mean() < 0.5 else None, cosine)
            rows, low, size = rows[~crowd], low[~crowd], size[~crowd]
            which = np.repeat(np.arange(len(rows)), size.sum(1))
            found = self.order.ravel()[ragged(low.ravel(), size.ravel())]
            codes, sims = [], []
            for a in range(0, len(found), _PAIRS):
                w, v = which[a : a + _PAIRS], found[a : a + _PAIRS]
                sim = np.einsum("nd,nd->n", q[rows[w]], self.x[v])
                near = sim >= cosine
                codes.append(w[near] * n + v[near])
                sims.append(sim[near])
            if codes:
                code, first = np.unique(np.concatenate(codes), return_index=True)
                yield rows[code // n], code % n, np.concatenate(sims)[first]

    def _product(self, q: np.ndarray, rows: np.ndarray, some: np.ndarray | None, cosine: float) -> Iterator[tuple]:
        x = self.x if some is None else self.x[some]
        step = max(1, _PRODUCT // max(1, len(x)))
        for at in range(0, len(rows), step):
            sims = q[rows[at : at + step]] @ x.T
            a, b = np.nonzero(sims >= cosine)
            yield rows[at + a], b if some is None else some[b], sims[a, b]

    def within(self, q: np.ndarray, cosine: float, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) found at ``cosine`` or nearer."""
        found = [(a, b) for a, b, _ in self.pairs(np.asarray(q, np.float32), cosine, width)]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *(a for a, _ in found)]), np.concatenate([none, *(b for _, b in found)])


def audited_width(graph: Graph, q: np.ndarray, cosine: float, width: int, recall: float) -> int:
    """The least doubled width whose links of these queries are ``recall`` of all their links."""
    exact = (q.astype(np.float32) @ graph.x.T) >= cosine
    total = int(exact.sum())
    while width < TABLES:
        a, b = graph.within(q, cosine - OFF, width)
        if exact[a, b].sum() >= recall * total:
            return width
        width *= 2
    return width


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors scaled to length 1; by the largest component first, so that squares neither overflow nor vanish."""
    s = vectors.astype(np.float64)
    s /= np.abs(s).max(1, keepdims=True, initial=0.0)
    norm = np.zeros(len(s))
    for d in range(s.shape[1]):
        norm += s[:, d] * s[:, d]
    s /= np.sqrt(norm)[:, None]
    return s


class _Cell:
    """The vectors of a shard, and links found between them and queries."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, copies: np.ndarray, cosine: float, width: int, recall: float):
        self.ids, self.x, self.copies, self.cosine, self.recall = ids, x, copies, cosine, recall
        self.graph = Graph(x)
        self.width = max(width, self.graph.tables(cosine, 1 - (1 - recall) / 10))
        self.links = np.zeros(len(ids), np.int64)

    def own(self) -> Iterator:
        """Links and forests between the shard's own vectors."""
        for at in range(0, len(self.ids), 4 * _QUERIES):
            rows = slice(at, at + 4 * _QUERIES)
            links, edges = self._meet(self.ids[rows], self.x[rows], self.copies[rows], at)
            self.links[rows] += links
            yield from edges

    def query(self, ids: np.ndarray, x: np.ndarray, copies: np.ndarray) -> Iterator:
        links, edges = self._meet(ids, x, copies, None)
        yield _rows(0, ids, links)
        yield from edges

    def counts(self):
        return _rows(0, self.ids, self.links)

    def _meet(self, ids: np.ndarray, x: np.ndarray, copies: np.ndarray, own: int | None) -> tuple[np.ndarray, list]:
        """The queries' numbers of links, and forests; the shard's own queries, from ``own`` on, meet each other vector once."""
        links, edges = np.zeros(len(ids), np.int64), []
        if not len(self.ids) or not len(ids):
            return links, edges
        q = x.astype(np.float32)
        some = np.linspace(0, len(q) - 1, min(len(q), AUDIT_QUERIES)).astype(int)
        self.width = audited_width(self.graph, q[some], self.cosine, self.width, self.recall)
        for a, b, sim in self.graph.pairs(q, self.cosine - OFF, self.width):
            keep = np.ones(len(a), bool) if own is None else a + own < b
            close = np.flatnonzero((sim < self.cosine + OFF) & keep)
            for at in range(0, len(close), _PAIRS):
                c = close[at : at + _PAIRS]
                keep[c] = np.einsum("nd,nd->n", x[a[c]], self.x[b[c]]) >= self.cosine
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            links += np.bincount(a, self.copies[b], minlength=len(ids)).astype(np.int64)
            self.links += np.bincount(b, copies[a], minlength=len(self.ids)).astype(np.int64)
            node, root = forest(ids[a], self.ids[b])
            edges.append(_rows(1, node, root))
        return links, edges


def _rows(kind: int, a: np.ndarray, b: np.ndarray):
    import pyarrow as pa

    if not kind:
        a, b = a[b > 0], b[b > 0]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])


def _search(cosine: float, width: int, recall: float, blocks: int):
    def run(batches: Iterator) -> Iterator:
        from blackbar.llm import embedding_dedup as E

        key, index, cell = None, [], None

        def opened() -> Iterator:
            """Make the shard's graph, once all its vectors are there."""
            nonlocal cell
            if cell is None and index:
                ids, x, copies = (np.concatenate(part) for part in zip(*index))
                cell = E._Cell(ids, x, copies, cosine, width, recall)
                index.clear()
                # of the cells with one shard, one has these links
                if key % blocks == 0:
                    yield from cell.own()

        for batch in batches:
            cells, roles = batch.column("cell").to_numpy(), batch.column("role").to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]) | (roles[1:] != roles[:-1])])) if len(cells) else []
            for at, to in zip(edge, [*edge[1:], len(cells)]):
                part = batch.slice(int(at), int(to - at))
                if cells[at] != key:
                    if key is not None:
                        yield from opened()
                        if cell is not None:
                            yield cell.counts()
                    key, index, cell = int(cells[at]), [], None
                x = E.units(part.column("vector").flatten().to_numpy().reshape(part.num_rows, -1))
                own = part.column("id").to_numpy(), x, part.column("copies").to_numpy()
                if roles[at] == 0:
                    index.append(own)
                else:
                    yield from opened()
                    if cell is not None:
                        yield from cell.query(*own)
        if key is not None:
            yield from opened()
            if cell is not None:
                yield cell.counts()

    return run


def embedding_groups(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = COSINE,
    shards: int = SHARDS,
    shard_vectors: int = SHARD_VECTORS,
    query_block: int = QUERY_BLOCK,
    beam: int = BEAM,
    recall: float = AUDIT_RECALL,
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Equal vectors are one entry with a count. Entries are dealt over ``shards`` (more if a
    shard would exceed ``shard_vectors``); each shard has one graph, in which its own vectors
    and those of half of the other shards are queries, so that any two shards meet once, in
    tasks of one shard and ``query_block`` queries. A query's beam is the buckets that hold it
    in ``beam`` tables, or as many as miss a pair at ``cosine`` with a tenth of 1 - ``recall``.
    In each batch of a task, up to 256 queries are compared with the whole shard, and beams are
    doubled until ``recall`` of their links are found. Candidates are verified by cosine in double
    precision. Tasks return link counts and a spanning forest, not pairs.

    Vectors that are null, zero, hold null or non-finite components, have no id, or another
    length than most, link with nothing: n_links 0, component_id their own id, kept. Of equal
    rows each counts as a vector and links with the others; rows of one id and vector are kept
    together. An empty table gives no rows. Only the two named columns are read.
    """
    v = F.col("vector")
    # single components stay single, as they are moved often
    of = vectors.select(vector_col).schema[0].dataType
    kind = "array<float>" if isinstance(of, ArrayType) and isinstance(of.elementType, FloatType) else "array<double>"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast(kind).alias("vector"))
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    top = F.array_max(F.transform(v, F.abs))
    usable = F.coalesce(F.col("id").isNotNull() & (F.size(v) > 0) & finite & (top > 0), F.lit(False))
    valid = rows.where(usable)
    sizes = valid.groupBy(F.size(v).alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    dims = sizes[0]["dims"] if sizes else 0
    entries = store(
        valid.where(F.size(v) == dims).groupBy("vector").agg(F.min("id").alias("entry"), F.count(F.lit(1)).alias("copies")),
        "entries",
    )
    total = entries.count()
    shards = max(1, shards, -(-total // shard_vectors))
    blocks = max(1, -(-total // query_block))
    parts = entries.select(F.col("entry").alias("id"), "copies", "vector")
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")
    own = F.sequence(F.lit(0), F.lit(blocks - 1))
    # the shards behind a vector's own; of two that are opposite, one queries the other
    half = (shards - 1) // 2
    ahead = F.when(shard < shards // 2, half + 1).otherwise(half) if shards % 2 == 0 else F.lit(half)
    others = F.filter(F.sequence(F.lit(0), F.lit(shards // 2)), lambda d: (d > 0) & (d <= ahead))
    index = parts.select(F.explode(F.transform(own, lambda b: shard * blocks + b)).alias("cell"), F.lit(0).alias("role"), "id", "copies", "vector")
    query = parts.select(
        F.explode(F.transform(others, lambda d: ((shard + d) % shards) * blocks + block)).alias("cell"), F.lit(1).alias("role"), "id", "copies", "vector"
    )
    found = store(
        index.union(query).repartitionById(shards * blocks, F.col("cell")).sortWithinPartitions("cell", "role")
        .mapInArrow(_search(cosine, beam, recall, blocks), "kind int, a bigint, b bigint"),
        "vector-links",
    )
    links = found.where("kind = 0").groupBy(F.col("a").alias("entry")).agg(F.sum("b").alias("links"))
    root = connected(found.where("kind = 1").select("a", "b"))
    known = entries.join(links, "entry", "left").join(root, F.col("entry") == F.col("node"), "left").select(
        F.col("vector").alias("of_vector"),
        F.xxhash64("vector").alias("of_hash"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
        F.coalesce("component", "entry").alias("component"),
    )
    judged = rows.withColumn("usable", usable & (F.size(v) == dims))
    # by hash first, as sorting compares vectors slowly
    same = (F.xxhash64("vector") == F.col("of_hash")) & (F.col("vector") == F.col("of_vector"))
    joined = judged.join(known, F.col("usable") & same, "left")
    component = F.coalesce("component", "id")
    return joined.select(
        F.col("id").alias("vec_id"),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
