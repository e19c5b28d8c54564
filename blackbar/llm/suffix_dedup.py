"""Removal of long repeated byte strings, by interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blackbar.llm.common import mix64, own_name, spread, store
from blackbar.llm.words import ragged

LENGTH = 200
GRAM = 40
# Different strings of one anchor that a task gathers, at most 360 bytes each (7 MB); those of
# an anchor with more are counted over all tasks.
HOT_ANCHOR = 20_000
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_R = 0x9E3779B97F4A7C15
_R_INVERSE = pow(_R, -1, 1 << 64)
_PLACE_BITS = 31
_SOLVE_BYTES = 400_000


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each place of a byte array."""
    n = len(data)
    if len(_POWERS[0]) < n + 1:
        _POWERS[:] = [_powers(_R, n + 1), _powers(_R_INVERSE, n + 1)]
    sums = _BYTE[data]
    sums *= _POWERS[1][:n]
    np.cumsum(sums, out=sums)
    sums = np.concatenate([np.zeros(1, np.uint64), sums])
    out = sums[gram:] - sums[:-gram]
    out *= _POWERS[0][: len(out)]
    return mix64(out)


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, hash, first, last): strings of ``length`` bytes by what they hold.

    The anchor of a string is the gram in it with the lowest hash, the rightmost if there are
    several, so equal strings have equal anchors at equal places. Each row is a run of
    neighbouring starts, first to last, whose strings share one anchor; every string of every
    text is in exactly one run.
    """
    empty = np.zeros(0, np.int64)
    if not texts or max(map(len, texts)) < length:
        return empty, empty.astype(np.uint64), empty, empty
    data = np.frombuffer(b"".join(texts) + bytes(length), np.uint8)
    full = gram_hashes(data, gram)
    place = np.uint64((1 << _PLACE_BITS) - 1)
    key = (full >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | (place - np.arange(len(full), dtype=np.uint64))
    width, have, low = length - gram + 1, 1, key
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size) - size
    starts = np.maximum(0, size - length + 1)
    start = ragged(begin, starts)
    owner = np.repeat(np.arange(len(texts)), starts)
    low = low[start]
    edge = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])]))
    last = np.append(edge[1:], len(start)) - 1
    at = (place - (low[edge] & place)).astype(np.int64)
    text = owner[edge]
    return text, full[at], start[edge] - begin[text], start[last] - begin[text]


def suffix_order(symbols: np.ndarray, group: np.ndarray, rest: np.ndarray, length: int) -> np.ndarray:
    """Suffixes in order of (group, up to ``length`` bytes or more), by prefix doubling.

    symbols: bytes + 1, and 0 as the end of each string; rest: how many symbols follow in the
    string. Suffixes equal up to their ends, or in all these bytes, keep the order of places.
    """
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(4, np.int64)])
    key = np.where(symbols == 0, -1, group)
    open_ = np.ones(n, bool)
    for d in range(4):
        open_ &= rest >= d
        key = (key << 9) | np.where(open_, padded[d : d + n], 0)
    order = np.argsort(key, kind="stable")
    have = 4
    while True:
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
        if have >= length or rank[order[-1]] == n - 1:
            return order
        follow = np.where(rest >= have, rank[np.minimum(np.arange(n) + have, n - 1)] + 1, 0)
        key = rank * (n + 2) + follow
        order = np.argsort(key, kind="stable")
        have *= 2


def long_prefixes(symbols: np.ndarray, group: np.ndarray, rest: np.ndarray, length: int) -> np.ndarray:
    """Places whose suffix shares at least ``length`` bytes with another suffix of its group.

    Common prefixes of neighbours in suffix order are found by increasing value: the interval
    of a string w in that order is extended backward by every symbol c before it, which gives
    the interval of cw; its right border has the common prefix |w| unless it had one before,
    and only then cw is extended in turn. The expansion stops at ``length``: borders that
    have no value by then are common prefixes of at least ``length`` bytes.
    """
    n = len(symbols)
    # an order by the first `length` bytes would not be closed under backward extension
    order = suffix_order(symbols, group, rest, int(rest.max()) + 1)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    # the Burrows-Wheeler transform and its step back; -1 where a string begins
    begins = np.concatenate([[True], symbols[:-1] == 0])
    back = np.where(begins[order], -1, place[order - 1])
    before = symbols[order - 1] + group[order - 1] * 257
    known = np.zeros(n + 1, bool)
    ends = int((symbols == 0).sum())
    known[: ends + 1] = True
    known[n] = True
    # strings of length one: every end by itself, and each symbol of each group
    head = (symbols + group * 257)[order[ends:]]
    cut = np.concatenate([[0], np.flatnonzero(head[1:] != head[:-1]) + 1, [len(head)]]) + ends
    known[cut[1:]] = True
    left = np.concatenate([np.arange(ends), cut[:-1]])
    right = np.concatenate([np.arange(ends), cut[1:] - 1])
    for _ in range(1, length):
        if not len(left):
            break
        one = left == right
        single = back[left[one]]
        single = single[single >= 0]
        left, right = left[~one], right[~one]
        if len(left):
            width = right - left + 1
            at = ragged(left, width)
            owner = np.repeat(np.arange(len(left)), width)
            to, symbol = back[at], before[at]
            some = to >= 0
            to, symbol, owner = to[some], symbol[some], owner[some]
            by = np.argsort(to)
            to, symbol, owner = to[by], symbol[by], owner[by]
            new = np.flatnonzero(np.concatenate([[True] * bool(len(to)), (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])]))
            left, right = to[new], to[np.append(new[1:], len(to)) - 1] if len(new) else to[new]
        left, right = np.concatenate([left, single]), np.concatenate([right, single])
        fresh = ~known[right + 1]
        left, right = left[fresh], right[fresh]
        known[right + 1] = True
    return order[~known[:-1] | ~known[1:]]


def repeated_starts(strings: list[bytes], group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, start) of all substrings of ``length`` bytes that start elsewhere in the group too."""
    size = np.array([len(s) + 1 for s in strings], np.int64)
    symbols = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
    begin = np.cumsum(size) - size
    symbols[begin + size - 1] = 0
    owner = np.repeat(np.arange(len(strings)), size)
    start = np.arange(len(symbols)) - begin[owner]
    found = long_prefixes(symbols, group[owner], size[owner] - 1 - start, length)
    found.sort()
    return owner[found], start[found]


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from blackbar.llm.suffix_dedup import anchors
        from blackbar.llm.words import by_bytes, rows_of

        for keys, texts in by_bytes(rows_of(batches), 600_000):
            text, code, first, last = anchors([t.encode() for t in texts], length, gram)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(keys, np.int64)[text]), pa.array(code.view(np.int64)), pa.array(first), pa.array(last)],
                names=["body", "anchor", "first", "last"],
            )

    return run


def _cut_strings(length: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["head", "body", "anchor", "firsts", "piece"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
        rows: list[tuple] = []

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
            rows.clear()
            return out

        for batch in batches:
            head, body, text, runs = batch.columns
            offsets = runs.offsets.to_numpy()
            anchor, first, last = (c.to_numpy(zero_copy_only=False) for c in runs.flatten().flatten())
            offsets = offsets - offsets[0]
            for i in range(batch.num_rows):
                data = text[i].as_py().encode()
                h, b = head[i].as_py(), body[i].as_py()
                places: dict[tuple[int, bytes], list[int]] = {}
                for j in range(offsets[i], offsets[i + 1]):
                    piece = data[first[j] : last[j] + length]
                    if len(piece) >= length:
                        places.setdefault((anchor[j], piece), []).append(first[j])
                rows.extend((h, b, a, at, piece) for (a, piece), at in places.items())
                if len(rows) >= 2000:
                    yield flush()
        if rows:
            yield flush()

    return run


def _solve(length: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from blackbar.llm import suffix_dedup as S

        held: list[tuple] = []
        size = 0

        def flush(last: bool):
            nonlocal held, size
            cut = len(held)
            if not last:
                while cut and held[cut - 1][0] == held[-1][0]:
                    cut -= 1
            now, held = held[:cut], held[cut:]
            size = sum(len(r[1]) for r in held)
            if not now:
                return None
            anchor = np.array([r[0] for r in now], np.int64)
            n = np.array([r[2] for r in now])
            names, group, count = np.unique(anchor, return_inverse=True, return_counts=True)
            # a string that is alone with its anchor repeats if it was found more than once
            several = np.flatnonzero(count[group] > 1)
            owner, start = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if len(several):
                own, start = S.repeated_starts([now[i][1] for i in several.tolist()], group[several], length)
                owner = several[own]
            keep = n[owner] == 1
            owner, start = owner[keep], start[keep]
            whole = np.flatnonzero(n > 1)
            new = np.concatenate([[True] * bool(len(owner)), (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)])
            edge = np.flatnonzero(new)
            stop = start[np.append(edge[1:], len(owner)) - 1] if len(edge) else start
            which = np.concatenate([owner[edge], whole])
            a = np.concatenate([start[edge], np.zeros(len(whole), np.int64)])
            b = np.concatenate([stop, np.array([len(now[i][1]) - length for i in whole.tolist()], np.int64)])
            by = np.argsort(which, kind="stable")
            which, begin = np.unique(which[by], return_index=True)
            spans = pa.StructArray.from_arrays([pa.array(a[by]), pa.array(b[by])], names=["from", "to"])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor[which]),
                    pa.array([now[i][3] for i in which.tolist()], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.append(begin, len(by)), pa.int32()), spans),
                ],
                names=["anchor", "piece_key", "spans"],
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                size += len(row[1])
                if size >= S._SOLVE_BYTES and held[0][0] != row[0] and (out := flush(False)) is not None:
                    yield out
        if held and (out := flush(True)) is not None:
            yield out

    return run


def _apply():
    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        from blackbar.llm.suffix_dedup import keep_bytes

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = []
                for sha, text, runs in zip(*(c.to_pylist() for c in batch.slice(at, 200).columns)):
                    kept, removed, spans = keep_bytes(text.encode(), [(r["from"], r["to"]) for r in runs])
                    rows.append((sha, removed, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in zip(*rows)], names=["sha", "n_removed", "n_spans", "kept_sha256", "kept_text"]
                )

    return run


def keep_bytes(data: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left without the bytes from ``from`` up to before ``to`` of each run."""
    out, at, spans, end = [], 0, 0, -1
    for a, b in sorted(runs):
        if a > end:
            spans += 1
            out.append(data[at:a])
        end = at = max(end, b)
    out.append(data[max(at, 0) :])
    kept = b"".join(out)
    return kept, len(data) - len(kept), spans


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    body = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("bigint").alias("id"), body.alias("body_text"), F.sha2(F.encode(body, "UTF-8"), 256).alias("sha")
    )


def repeated_runs(rows: DataFrame, heads: DataFrame, length: int, gram: int, hot_anchor: int) -> DataFrame:
    """Per text (``head`` and ``body``) with repeats: runs array<from, to>, the bytes that repeats cover.

    1. Every string of ``length`` bytes is filed under its anchor; anchors that only one place
       has are dropped. This moves a few bytes per anchor, not the text.
    2. Of each text, one copy is read again and cut to the strings filed under other anchors;
       equal cuts of a text are one row with their places, equal cuts of all texts one with a count.
    3. Cuts of one anchor are searched for common prefixes of ``length`` bytes by interval
       expansion. Where an anchor has more than ``hot_anchor`` different cuts they are not
       gathered: their strings are counted by digest, combined before the shuffle.
    4. A cut with repeats is one row with all its repeats, which goes back to the texts that hold it.
    """
    pairs = spread(rows.select(F.xxhash64("sha").alias("body"), "body_text"))
    found = pairs.mapInArrow(_anchor_rows(length, gram), "body bigint, anchor bigint, first bigint, last bigint")
    mark = F.xxhash64("body", "first")
    often = store(
        found.groupBy("anchor").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).where("low <> high").select("anchor"),
        "anchors",
    )
    run = F.struct("anchor", "first", "last")
    runs = found.join(often.hint("merge"), "anchor").groupBy("body").agg(F.collect_set(run).alias("runs"))
    by_head = store(runs.join(heads.withColumn("body", F.xxhash64("sha")).hint("merge"), "body").select("sha", "head", "runs"), "runs")
    # a text has two numbers of its own here: its id and a hash
    at_head = _at_head(rows, by_head).select(
        F.coalesce("head", F.lit(0)).alias("head"), F.xxhash64("sha").alias("body"), "body_text", "runs"
    )
    pieces = store(
        at_head.mapInArrow(_cut_strings(length), "head bigint, body bigint, anchor bigint, firsts array<bigint>, piece binary")
        .withColumn("piece_key", F.xxhash64("piece")),
        "pieces",
    )
    # by the number of different cuts, however often each comes; only keys are moved for it
    keys = pieces.select("anchor", "piece_key").distinct()
    hot = store(keys.groupBy("anchor").count().where(F.col("count") > hot_anchor).select("anchor"), "hot")
    if hot.isEmpty():
        solved = _solved(_merged(pieces), length)
    else:
        few, many = (pieces.join(hot.hint("merge"), "anchor", how) for how in ("left_anti", "left_semi"))
        solved = _solved(_merged(few), length).unionByName(_counted(_merged(many), length))
    solved = store(solved, "solved")
    hits = pieces.select("head", "body", "anchor", "firsts", "piece_key").join(solved.hint("merge"), ["anchor", "piece_key"])
    covered = F.flatten(F.transform("firsts", lambda first: F.transform(
        "spans", lambda s: F.struct((first + s["from"]).alias("from"), (first + s["to"] + length).alias("to"))
    )))
    return hits.groupBy("head", "body").agg(F.flatten(F.collect_set(covered)).alias("runs"))


def _merged(pieces: DataFrame) -> DataFrame:
    """Each cut once, with how often it stands anywhere."""
    # equal rows are read several times here; they only repeat strings of texts that go anyway
    n = F.sum(F.size("firsts")).cast("bigint").alias("n")
    return pieces.groupBy("anchor", "piece_key", "piece").agg(n).select("anchor", "piece", "n", "piece_key")


def _solved(once: DataFrame, length: int) -> DataFrame:
    """Cuts with repeats and the first and last starts of each stretch, by interval expansion."""
    return once.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        _solve(length), "anchor bigint, piece_key bigint, spans array<struct<from: bigint, to: bigint>>"
    )


def _counted(once: DataFrame, length: int) -> DataFrame:
    """The same as ``_solved`` where an anchor has too many cuts for one task."""
    starts = once.select(
        "anchor", "n", "piece_key", "piece",
        F.explode(F.sequence(F.lit(0), F.octet_length("piece") - length)).alias("from"),
    ).select(
        "anchor", "n", "piece_key", F.col("from").cast("bigint"),
        F.sha2(F.expr(f"substring(piece, from + 1, {length})"), 256).alias("string"),
    )
    many = store(starts.groupBy("anchor", "string").agg(F.sum("n").alias("total")).where("total > 1"), "strings")
    # a cut has at most as many starts as a string has grams
    found = starts.join(many.hint("merge"), ["anchor", "string"]).groupBy("anchor", "piece_key").agg(
        F.array_sort(F.collect_set("from")).alias("at")
    )
    return found.select("anchor", "piece_key", F.arrays_zip(
        F.filter("at", lambda x: ~F.array_contains("at", x - 1)).alias("from"),
        F.filter("at", lambda x: ~F.array_contains("at", x + 1)).alias("to"),
    ).alias("spans"))


def _at_head(rows: DataFrame, by_head: DataFrame) -> DataFrame:
    """(sha, head, body_text, runs) of the one copy of each text that brings it."""
    h = by_head.hint("merge").withColumnRenamed("sha", "head_sha")
    same = (F.col("sha") == F.col("head_sha")) & F.col("id").eqNullSafe(F.col("head"))
    return rows.join(h, same).select("sha", "head", "body_text", "runs")


def cut_texts(
    docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH, gram: int = GRAM, hot_anchor: int = HOT_ANCHOR
) -> tuple[DataFrame, DataFrame]:
    """(texts found once that lose something, by ``sha``; ``sha`` and copies of all other texts)."""
    rows = _rows(docs, id_col, text_col)
    heads = store(rows.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("head")), "heads")
    runs = repeated_runs(rows, heads.select("sha", "head"), length, gram, hot_anchor)
    alone = heads.where("copies = 1").select(
        "sha", F.col("head").alias("own"), F.coalesce("head", F.lit(0)).alias("head"), F.xxhash64("sha").alias("body")
    )
    single = store(runs.join(alone.hint("merge"), ["head", "body"]).select("sha", F.col("own").alias("head"), "runs"), "single")
    cut = _at_head(rows, single).select("sha", "body_text", "runs").mapInArrow(
        _apply(), "sha string, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string"
    )
    return store(cut, "cut"), heads.where("copies > 1").select("sha", "copies")


def suffix_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
    gram: int = GRAM, hot_anchor: int = HOT_ANCHOR,
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte covered by a string of ``length`` bytes that also starts anywhere else, in the
    same text or another, is removed; strings are judged on the input. Null texts are empty;
    texts shorter than ``length`` stay whole; a text of that length or more that comes twice
    (equal rows too) loses everything. Null ids are kept. An empty table gives no rows; only
    the two named columns are read. ``removed_texts`` gives the texts that are left.
    """
    cut, copies = cut_texts(docs, id_col, text_col, length, gram, hot_anchor)
    rows = _rows(docs, id_col, text_col).select(
        "id", "sha", F.octet_length("body_text").cast("bigint").alias("n_bytes")
    )
    joined = rows.join(cut.drop("kept_text").hint("merge"), "sha", "left").join(copies.hint("merge"), "sha", "left")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return joined.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def removed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input rows with their texts replaced by what is left of them.

    Of a character that a removal cut through, the rest goes too, so texts stay UTF-8.
    """
    length = options.get("length", LENGTH)
    cut, copies = cut_texts(docs, id_col, text_col, **options)
    mark = F.sha2(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"), 256)
    sha, kept, times = (own_name(docs, c) for c in ("sha", "kept", "copies"))
    joined = docs.withColumn(sha, mark).join(
        cut.select(F.col("sha").alias(sha), F.col("kept_text").alias(kept)).hint("merge"), sha, "left"
    ).join(copies.select(F.col("sha").alias(sha), F.col("copies").alias(times)).hint("merge"), sha, "left")
    gone = (F.col(times) > 1) & (F.octet_length(text_col) >= length)
    text = F.when(gone, "").otherwise(F.coalesce(kept, F.col(text_col)))
    return joined.withColumn(text_col, text).select(*docs.columns)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that repeat."""
    return removed_texts(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
