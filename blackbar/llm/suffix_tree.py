"""Language-model scores by a probabilistic suffix tree over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blackbar.llm.common import mix64, spread, store
from blackbar.llm.toxicity import crc_of
from blackbar.llm.words import Words

PART_BYTES = 6_000_000
# A context becomes a state if its divergence from the root is worth so many nats: twice that is
# the 1 % point of chi-square with one degree of freedom.
DIVERGENCE = 3.32
# A state seen n times weighs the distribution of its suffix as n ** SMOOTHING observations.
SMOOTHING = 0.85
# Words of at least this share of all tokens are known in every task: at most 1 / share words.
FREQUENT = 1e-4
# Words of at least this share are always states, and their followers are dealt out in slices.
HOT = 1e-3
END = np.uint64(0x1DEA5EED0F7E57ED)
_X_BITS = 24
_CTX = np.uint64((1 << 40) - 1)
_KEYS_PER_BUCKET = 3_000_000


def _pack(values: np.ndarray) -> bytes:
    """Byte planes of integers, compressed."""
    import zstandard

    data = np.ascontiguousarray(values)
    planes = data.view(np.uint8).reshape(len(data), data.itemsize).T.tobytes() if len(data) else b""
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind) if len(raw) else np.zeros(0, kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, "<u8"), dtype=np.uint64)


class Part:
    """The tokens of some documents: hashes of words and one END per document."""

    def __init__(self, blob: bytes, lengths: list[int], held_out: list[bool]):
        import zstandard

        data = zstandard.ZstdDecompressor().decompress(blob) if lengths else b""
        at = np.concatenate([[0], np.cumsum(lengths)]).astype(int).tolist()
        words = Words([data[a:b].lower() for a, b in zip(at, at[1:])])
        n = np.diff(words.first)
        self.doc = np.repeat(np.arange(len(n)), n + 1)
        self.token = np.full(len(self.doc), END, np.uint64)
        last = np.cumsum(n + 1) - 1
        inside = np.ones(len(self.doc), bool)
        inside[last] = False
        self.token[inside] = words.hash
        self.train = ~np.array(held_out, bool)[self.doc] if len(n) else inside
        self.place = np.arange(len(self.doc)) - np.repeat(last - n, n + 1)

    def contexts(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions that have a context of so many words, keys of context and next word)."""
        at = np.flatnonzero(self.place >= order)
        ctx = mix64(self.token[at - 1])
        for d in range(2, order + 1):
            ctx = mix64(ctx * np.uint64(3) + self.token[at - d])
        return at, ((ctx & _CTX) << np.uint64(_X_BITS)) | (mix64(self.token[at]) >> np.uint64(64 - _X_BITS))


def context_of(token: np.ndarray) -> np.ndarray:
    return mix64(token) & _CTX


def gathered(part: Part, order: int, buckets: int, hot: np.ndarray) -> tuple:
    """Distinct keys of a part by bucket: (keys, bucket, training count, positions, number of each)."""
    if order == 0:
        at, keys = np.arange(len(part.token)), part.token
    else:
        at, keys = part.contexts(order)
    found, number = np.unique(keys, return_inverse=True)
    count = np.bincount(number, part.train[at], minlength=len(found)).astype(np.uint32)
    if order == 0:
        bucket = found % np.uint64(buckets)
    else:
        ctx = found >> np.uint64(_X_BITS)
        bucket = mix64(ctx) % np.uint64(buckets)
        if order == 1 and len(hot):
            is_hot = np.isin(ctx, hot)
            bucket = np.where(is_hot, mix64(found) % np.uint64(buckets), bucket)
    by = np.argsort(bucket, kind="stable")
    back = np.empty(len(by), np.int64)
    back[by] = np.arange(len(by))
    return found[by], bucket[by].astype(np.int64), count[by], at, back[number]


def _collect_parts(size: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        from blackbar.llm.words import by_bytes, rows_of

        number = TaskContext.get().partitionId() << 32
        for keys, texts in by_bytes((((i, h), t) for i, h, t in rows_of(batches)), size):
            data = [t.encode() for t in texts]
            blob = zstandard.ZstdCompressor(level=3).compress(b"".join(data))
            tokens = sum(len(d.split()) + 1 for d, (_, h) in zip(data, keys) if not h)
            yield pa.RecordBatch.from_pydict(
                {"part": [number], "ids": [[i or 0 for i, _ in keys]], "named": [[i is not None for i, _ in keys]], "held": [[h for _, h in keys]],
                 "lengths": [[len(d) for d in data]], "blob": [blob], "train_tokens": [tokens]},
                schema=pa.schema([("part", pa.int64()), ("ids", pa.list_(pa.int64())), ("named", pa.list_(pa.bool_())), ("held", pa.list_(pa.bool_())),
                                  ("lengths", pa.list_(pa.int64())), ("blob", pa.binary()), ("train_tokens", pa.int64())]),
            )
            number += 1

    return run


PARTS = "part bigint, ids array<bigint>, named array<boolean>, held array<boolean>, lengths array<bigint>, blob binary, train_tokens bigint"
KEYS = "ord int, bucket bigint, part bigint, keys binary, counts binary"


def _send_keys(orders: tuple[int, ...], buckets: int, hot: np.ndarray):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from blackbar.llm import suffix_tree as T

        for batch in batches:
            for i in range(batch.num_rows):
                number, held, lengths, blob = (batch.column(c)[i].as_py() for c in ("part", "held", "lengths", "blob"))
                part = T.Part(blob, lengths, held)
                for order in orders:
                    keys, bucket, count, _, _ = T.gathered(part, order, buckets, hot)
                    edge = np.flatnonzero(np.concatenate([[True] * bool(len(bucket)), bucket[1:] != bucket[:-1]]))
                    rows = [
                        (order, int(bucket[a]), number, T._pack_keys(keys[a:b]), T._pack(count[a:b]))
                        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(bucket)])
                    ]
                    for at in range(0, len(rows), 64):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*rows[at : at + 64]), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                            names=["ord", "bucket", "part", "keys", "counts"],
                        )

    return run


def divergence(n: np.ndarray, most: np.ndarray, share: np.ndarray) -> np.ndarray:
    """n times the divergence of (most / n, rest) from (share, rest), in nats.

    Of the distribution after a context and at the root, this is the divergence once all
    symbols but the context's most frequent one are merged, so never more than the full one.
    """
    p = most / np.maximum(n, 1)
    rest = np.where(p < 1, (1 - p) * np.log(np.maximum(1 - p, 1e-300) / (1 - share)), 0.0)
    return n * np.where(p > share, p * np.log(np.maximum(p, 1e-300) / share) + rest, 0.0)


REPLY = "kind int, ord int, part bigint, bucket bigint, word bigint, count bigint, data binary"


def _merge(total: int, threshold: float, frequent: dict, hot: np.ndarray, share: float):
    """Per bucket: counts over all parts, whether each context is a state, and an answer per part."""
    names = np.array(sorted(frequent), np.uint64)
    shares = np.array([frequent[k] for k in sorted(frequent)], float)

    def run(frame):
        import pandas as pd

        from blackbar.llm import suffix_tree as T

        order, bucket = int(frame["ord"].iloc[0]), int(frame["bucket"].iloc[0])
        frame = frame.sort_values("part")
        keys = [T._unpack_keys(k) for k in frame["keys"]]
        counts = np.concatenate([T._unpack(c, "<u4") for c in frame["counts"]]).astype(np.float64)
        found, number = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(number, counts, minlength=len(found)).astype(np.int64)
        rows = []
        if order == 0:
            answer = sums.astype(np.uint32)
            rows.append((1, 0, None, bucket, None, int((sums > 0).sum()), None))
            often = np.flatnonzero(sums >= max(1, share * total))
            rows += [(2, 0, None, bucket, int(found[i].view(np.int64)), int(sums[i]), None) for i in often]
        else:
            ctx = found >> np.uint64(T._X_BITS)
            first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
            size = np.diff(np.append(first, len(ctx)))
            n = np.add.reduceat(sums, first)
            most = np.maximum.reduceat(sums, first)
            top = np.flatnonzero(sums == np.repeat(most, size))
            owner = np.repeat(np.arange(len(first)), size)[top]
            best = top[np.unique(owner, return_index=True)[1]]
            x = found[best] & np.uint64((1 << T._X_BITS) - 1)
            at = np.minimum(np.searchsorted(names, x), max(len(names) - 1, 0))
            q = np.where(names[at] == x, shares[at], share) if len(names) else np.full(len(x), share)
            state = T.divergence(n, most, np.minimum(q, 0.999999)) > threshold
            if order == 1 and len(hot):
                state |= np.isin(ctx[first], hot)
            answer = (sums.astype(np.uint32) << np.uint32(1)) | np.repeat(state, size).astype(np.uint32)
        at = 0
        for part, k in zip(frame["part"], keys):
            rows.append((0, order, int(part), bucket, None, None, T._pack(answer[number[at : at + len(k)]])))
            at += len(k)
        # whole numbers beyond 2**53 must not pass through floats
        return pd.DataFrame({
            name: pd.array(column, "Int64") if name in ("part", "word", "count") else list(column)
            for name, column in zip(("kind", "ord", "part", "bucket", "word", "count", "data"), zip(*rows))
        })

    return run


SCORES = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
    "base_score double, score double, n_state_tokens bigint"
)


def _score(total: int, distinct: int, buckets: int, hot: np.ndarray, smoothing: float):
    def run(parts, replies):
        import pandas as pd

        from blackbar.llm import suffix_tree as T

        out = []
        for row in parts.itertuples():
            held = [bool(x) for x in row.held]
            part = T.Part(row.blob, [int(x) for x in row.lengths], held)
            value = []
            for order in (0, 1, 2):
                _, bucket, _, at, number = T.gathered(part, order, buckets, hot)
                mine = replies[replies["ord"] == order].sort_values("bucket")
                answer = np.concatenate([T._unpack(d, "<u4") for d in mine["data"]]) if len(mine) else np.zeros(0, np.uint32)
                value.append((at, answer[number]))
            c0 = value[0][1].astype(float)
            base = (c0 + 0.5) / (total + 0.5 * (distinct + 1))
            p = base.copy()
            depth = np.zeros(len(p), int)
            seen = c0  # how often the context of each order that ends before a position was seen
            for order in (1, 2):
                at, a = value[order]
                count, state = (a >> 1).astype(float), (a & 1) == 1
                n = seen[at - 1]
                k = np.maximum(n, 1) ** smoothing
                use = state & (n > 0)
                p[at] = np.where(use, (count + k * p[at]) / (n + k), p[at])
                depth[at[use]] = order
                seen = np.zeros(len(p))
                seen[at] = count
            docs = len(held)
            sums = lambda w: np.bincount(part.doc, w, minlength=docs)
            out.append(pd.DataFrame({
                "doc_id": pd.array([int(i) if n else None for i, n in zip(row.ids, row.named)], "Int64"),
                "held_out": held,
                "n_tokens": sums(np.ones(len(p))).astype(np.int64),
                "n_known": sums(c0 > 0).astype(np.int64),
                "train_tokens": total,
                "base_score": sums(np.log10(base)),
                "score": sums(np.log10(p)),
                "n_state_tokens": sums(depth > 0).astype(np.int64),
            }))
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in T.SCORES.split(", ")})

    return run


def suffix_tree_scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = DIVERGENCE,
    smoothing: float = SMOOTHING,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The tree's contexts are the last one and two words. A context is a state if what follows
    it diverges from the root by more than ``threshold`` nats (``divergence``). The
    distribution of a state seen n times is its counts and n ** ``smoothing`` observations of
    its suffix's distribution, down to the root, the base model. A word is scored by the
    longest state that ends before it. Documents whose crc32 of the id's text is 1 modulo 5
    are not counted.

    Documents are kept in parts. Each part sends its distinct words and n-grams, compressed,
    to buckets of the context's hash; buckets sum them and answer each part for what it sent,
    so neither counts nor model are ever whole in one place. Followers of words that make up
    over 1/1000 of all tokens are dealt out by pair. Words are known by 64-bit hashes,
    contexts by 40 bits and followers by 24.

    Null and empty texts are one END token. Null ids count as training rows. Repeated rows
    count and are scored as often as they come. An empty table gives no rows. Only the two
    named columns are read.
    """
    held = F.coalesce(crc_of(F.col(id_col)) % 5 == 1, F.lit(False))
    rows = spread(docs.select(F.col(id_col).cast("bigint").alias("id"), held.alias("held"), F.col(text_col).alias("text")))
    parts = store(rows.mapInArrow(_collect_parts(part_bytes), PARTS), "parts")
    total = parts.agg(F.coalesce(F.sum("train_tokens"), F.lit(0))).first()[0]
    buckets = max(24, -(-total // _KEYS_PER_BUCKET))
    none = np.zeros(0, np.uint64)
    one = store(
        parts.mapInArrow(_send_keys((0,), buckets, none), KEYS).groupBy("ord", "bucket")
        .applyInPandas(_merge(total, threshold, {}, none, FREQUENT), REPLY),
        "words",
    )
    distinct = one.where("kind = 1").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    # at most 1 / FREQUENT rows
    often = [(np.uint64(r["word"] & (2**64 - 1)), r["count"] / total) for r in one.where("kind = 2").select("word", "count").collect()]
    words = np.array([w for w, _ in often], np.uint64)
    frequent: dict = {}
    for k, (_, s) in zip((mix64(words) >> np.uint64(64 - _X_BITS)).tolist(), often):
        frequent[k] = frequent.get(k, 0.0) + s
    hot = np.sort(context_of(words[np.array([s >= HOT for _, s in often], bool)])) if often else none
    two = store(
        parts.mapInArrow(_send_keys((1, 2), buckets, hot), KEYS).groupBy("ord", "bucket")
        .applyInPandas(_merge(total, threshold, frequent, hot, FREQUENT), REPLY),
        "contexts",
    )
    replies = one.union(two).where("kind = 0").select("part", "ord", "bucket", "data")
    return parts.groupBy("part").cogroup(replies.groupBy("part")).applyInPandas(
        _score(total, distinct, buckets, hot, smoothing), SCORES
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
