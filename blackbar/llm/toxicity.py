"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blackbar.llm.common import mix64, own_name, spread
from blackbar.llm.words import Words, by_bytes, ragged

WORD_ROWS, GRAM_ROWS, DIM, HIDDEN = 1 << 15, 1 << 15, 8, 8
# Every start is scored; the network is fitted on windows TRAIN_STRIDE apart.
WINDOW, STRIDE, TRAIN_STRIDE = 32, 1, 24
THRESHOLD = 0.3
# The training sample: so many labelled rows of each label, texts of at most so many characters.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS = 1000, 2000, 6000
EPOCHS = 6
# A clean training text counts so many times as much as a toxic one.
CLEAN_WEIGHT = 3.0
_BATCH_WINDOWS = 2048
# So many runs of at most so many starts are scored together. Rows of 4,080 numbers do not all fall on the same lines
# of the processor's cache, which those of 4,096 do.
_RUN, _BESIDE = 255, 16

# Bytes that separate words: all ASCII but letters and digits.
_BREAK = bytes(
    b if b >= 128 or chr(b).isalnum() else 0x20 for b in range(256)
)


@dataclass
class Batch:
    """Texts as windows of word numbers; every distinct word has one row of features."""

    bucket: np.ndarray  # of each distinct word, its row of the word table
    gram: np.ndarray  # rows of the gram table, word after word
    grams: np.ndarray  # how many each distinct word has
    index: np.ndarray  # (windows, WINDOW): numbers of distinct words, -1 behind the last
    text: np.ndarray  # of each window, its text


def features(texts: list[str]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words, each one's distinct word, and of these the word row, the gram rows and their number."""
    words = Words([b" " + t.lower().encode().translate(_BREAK) for t in texts])
    place, number = words.distinct()
    bucket = (words.hash[place] % np.uint64(WORD_ROWS)).astype(np.int64)
    length = (words.end - words.start)[place]
    data = np.concatenate([np.where(words.bytes == 0x0A, 0x20, words.bytes), np.full(3, 0x20, np.uint8)]).astype(np.uint64)
    at = ragged(words.start[place], length)
    code = (data[at - 1] << np.uint64(24)) | (data[at] << np.uint64(16)) | (data[at + 1] << np.uint64(8)) | data[at + 2]
    # what follows a word's end is another word: grams end at the separator
    code = np.where(data[at + 1] == 0x20, code & np.uint64(0xFFFFFF00), code)
    gram = (mix64(code) % np.uint64(GRAM_ROWS)).astype(np.int64)
    return words, number, bucket, gram, length


def prepare(texts: list[str], stride: int = STRIDE) -> Batch:
    """All windows of WINDOW words, ``stride`` apart, the last one reaching the end of its text.

    A text without words has one window without words.
    """
    words, number, bucket, gram, length = features(texts)
    n = np.diff(words.first)
    windows = np.maximum(1, -(-np.maximum(n - WINDOW, 0) // stride) + 1)
    begin = np.repeat(words.first[:-1], windows) + stride * ragged(np.zeros(len(n), np.int64), windows)
    stop = np.repeat(words.first[1:], windows)
    index = begin[:, None] + np.arange(WINDOW)[None, :]
    inside = index < stop[:, None]
    number = np.append(number, 0)
    index = np.where(inside, number[np.minimum(index, len(number) - 1)], -1)
    return Batch(bucket, gram, length, index, np.repeat(np.arange(len(n)), windows))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _aligned(*shape: int) -> np.ndarray:
    """An array without values that begins at a cache line."""
    size = int(np.prod(shape))
    space = np.empty(size + 16, np.float32)
    skip = -space.ctypes.data % 64 // 4
    return space[skip : skip + size].reshape(shape)


class Network:
    """Word and character inputs, a GRU in each direction, attention over its states, a logit."""

    NAMES = ("words", "grams", "wx", "wb", "u", "att", "attb", "attv", "out", "outb")

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *shape: (r.standard_normal(shape) * 0.3).astype(np.float32)
        h = HIDDEN
        self.words, self.grams = f(WORD_ROWS, DIM) * 0.1, f(GRAM_ROWS, DIM) * 0.1
        self.wx, self.wb, self.u = f(2, 2 * DIM, 3 * h), np.zeros((2, 3 * h), np.float32), f(2, h, 3 * h)
        self.att, self.attb, self.attv = f(2 * h, h), np.zeros(h, np.float32), f(h)
        self.out, self.outb = f(2 * h), np.full(1, -1.0, np.float32)

    def inputs(self, bucket: np.ndarray, gram: np.ndarray, grams: np.ndarray) -> np.ndarray:
        x = np.zeros((len(bucket), 2 * DIM), np.float32)
        x[:, :DIM] = self.words[bucket]
        if len(bucket):
            sums = np.add.reduceat(self.grams[gram], np.cumsum(grams) - grams, axis=0)
            x[:, DIM:] = sums / np.sqrt(grams)[:, None]
        return x

    def gates(self, x: np.ndarray) -> list[np.ndarray]:
        """Of each direction, what every word brings to the gates; the last row is of no word."""
        none = np.zeros((1, 3 * HIDDEN), np.float32)
        return [np.vstack([x @ self.wx[d] + self.wb[d], none]).astype(np.float32) for d in (0, 1)]

    def states(self, x: np.ndarray, index: np.ndarray, keep: list | None = None) -> np.ndarray:
        return self.walk(self.gates(x), index, keep)

    def walk(self, gates: list[np.ndarray], index: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (WINDOW, windows, 2 * HIDDEN); behind a window's last word they do not change."""
        h, n = HIDDEN, len(index)
        out = np.zeros((WINDOW, n, 2 * h), np.float32)
        full = (index[:, -1] >= 0).all()
        columns = np.ascontiguousarray(index.T)
        for d in (0, 1):
            state = np.zeros((n, h), np.float32)
            for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
                gx = gates[d][columns[t]]
                gh = state @ self.u[d]
                rz = gx[:, : 2 * h] + gh[:, : 2 * h]
                rz *= 0.5
                np.tanh(rz, out=rz)
                rz *= 0.5
                rz += 0.5
                r, z = rz[:, :h], rz[:, h:]
                new = np.tanh(gx[:, 2 * h :] + r * gh[:, 2 * h :])
                nxt = new + z * (state - new)
                if not full:
                    nxt = np.where((index[:, t] >= 0)[:, None], nxt, state)
                if keep is not None:
                    keep.append((d, t, state, r, z, new, gh[:, 2 * h :]))
                state = nxt
                out[t, :, d * h : (d + 1) * h] = state
        return out

    def pool(self, states: np.ndarray, index: np.ndarray) -> tuple:
        a = np.tanh(states @ self.att + self.attb)
        e = a @ self.attv
        e = np.where(index.T >= 0, e, -1e9)
        e -= e.max(0)
        w = np.exp(e)
        w /= w.sum(0)
        pooled = np.einsum("tn,tnh->nh", w, states)
        return pooled @ self.out + self.outb[0], a, w, pooled

    def logits(self, batch: Batch) -> np.ndarray:
        gates = self.gates(self.inputs(batch.bucket, batch.gram, batch.grams))
        out = np.zeros(len(batch.index), np.float32)
        short = batch.index[:, -1] < 0
        for part in (np.flatnonzero(~short), np.flatnonzero(short)):
            for i in range(0, len(part), _BATCH_WINDOWS):
                some = batch.index[part[i : i + _BATCH_WINDOWS]]
                out[part[i : i + _BATCH_WINDOWS]] = self.pool(self.walk(gates, some), some)[0]
        return out

    def every_start(self, gates: list[np.ndarray], number: np.ndarray, begin: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of each run, the highest logit of the windows that start at ``starts`` words from ``begin`` on, as ``logits`` has them.

        Runs of up to _RUN starts, of like length, stand side by side: along the last axis lie their first words, then
        their second ones and so on, so the gate inputs of a step are one slice. With tanh(x / 2) for the sigmoids,
        halves are drawn into the weights.
        """
        h, best = HIDDEN, np.full(len(begin), -np.inf, np.float32)
        half = np.r_[np.full(2 * h, 0.5), np.ones(h)].astype(np.float32)
        u = [np.ascontiguousarray(self.u[d].T * np.float32(0.5)) for d in (0, 1)]
        read = np.ascontiguousarray(np.vstack([self.att.T, self.out[None]]))
        gates, attb = [g * half for g in gates], self.attb[:, None]
        space, steps, seen, weight, value = (
            _aligned(*k, _RUN * _BESIDE) for k in ((WINDOW, 2 * h), (3 * h,), (h + 1,), (WINDOW,), (WINDOW,))
        )
        room = [_aligned(3 * h, (_RUN + WINDOW - 1) * _BESIDE) for _ in gates]
        order = np.argsort(-starts, kind="stable")
        for at in range(0, len(order), _BESIDE):
            runs = order[at : at + _BESIDE]
            most, side = int(starts[runs[0]]), len(runs)
            n, wide = most * side, (most + WINDOW - 1) * side
            # behind a run's last word that word stands again, and what starts there is left out
            place = np.minimum(np.arange(most + WINDOW - 1)[:, None], starts[runs] + (WINDOW - 2)) + begin[runs]
            some = number[place.ravel()]
            inputs = [r[:, :wide] for r in room]
            for x, g in zip(inputs, gates):
                x[...] = g[some].T
            states, g = space[:, :, :n], steps[:, :n]
            r, z, new = g[:h], g[h : 2 * h], g[2 * h :]
            for d in (0, 1):
                state = None
                for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
                    x = inputs[d][:, t * side : t * side + n]
                    after = states[t, d * h : (d + 1) * h]
                    if state is None:  # nothing comes through the weights yet
                        np.tanh(x[h:], out=g[h:])
                        np.multiply(new, np.float32(-0.5), out=r)
                    else:
                        np.matmul(u[d], state, out=g)
                        g[: 2 * h] += x[: 2 * h]
                        np.tanh(g[: 2 * h], out=g[: 2 * h])
                        r *= new
                        new += r
                        new += x[2 * h :]
                        np.tanh(new, out=new)
                        np.subtract(state, new, out=r)
                        r *= np.float32(0.5)
                    np.multiply(z, r, out=after)
                    after += r
                    after += new
                    state = after
                    if d:  # both states of this place are known
                        np.matmul(read, states[t], out=seen[:, :n])
                        a = seen[:h, :n]
                        a += attb
                        np.tanh(a, out=a)
                        np.matmul(self.attv, a, out=weight[t, :n])
                        value[t, :n] = seen[h, :n]
            e, v = weight[:, :n], value[:, :n]
            e -= e.max(0)
            np.exp(e, out=e)
            v *= e
            logit = (v.sum(0) / e.sum(0) + self.outb[0]).reshape(most, side)
            logit[np.arange(most)[:, None] >= starts[runs]] = -np.inf
            best[runs] = logit.max(0)
        return best

    def gradients(self, x: np.ndarray, index: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of the weighted log loss, by parameter, and by input row."""
        h = HIDDEN
        keep: list = []
        states = self.states(x, index, keep)
        logit, a, w, pooled = self.pool(states, index)
        g = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES[2:]}
        dl = ((_sigmoid(logit) - y) * weight / len(y)).astype(np.float32)
        g["out"], g["outb"] = pooled.T @ dl, np.array([dl.sum()], np.float32)
        dp = dl[:, None] * self.out
        ds = w[:, :, None] * dp[None]
        dw = np.einsum("nh,tnh->tn", dp, states)
        de = w * (dw - (w * dw).sum(0))
        g["attv"] = np.einsum("tn,tnk->k", de, a)
        da = de[:, :, None] * self.attv * (1 - a * a)
        g["att"] = np.einsum("tnh,tnk->hk", states, da)
        g["attb"] = da.sum((0, 1))
        ds += da @ self.att.T
        dx = np.zeros((len(x) + 1, 2 * DIM), np.float32)
        carry = None
        for d, t, before, r, z, new, gn in reversed(keep):
            if carry is None or carry[0] != d:
                carry = (d, np.zeros_like(before))
            ds_t = carry[1] + ds[t, :, d * h : (d + 1) * h]
            on = (index[:, t] >= 0)[:, None]
            dn = ds_t * on
            dz = dn * (before - new) * z * (1 - z)
            dnew = dn * (1 - z) * (1 - new * new)
            dr = dnew * gn * r * (1 - r)
            dgx = np.concatenate([dr, dz, dnew], 1)
            dgh = np.concatenate([dr, dz, dnew * r], 1)
            g["u"][d] += before.T @ dgh
            xt = x[index[:, t]] * on
            g["wx"][d] += xt.T @ dgx
            g["wb"][d] += dgx.sum(0)
            np.add.at(dx, np.where(on[:, 0], index[:, t], len(x)), dgx @ self.wx[d].T)
            carry = (d, ds_t * ~on + dn * z + dgh @ self.u[d].T)
        return g, dx[:-1]


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Fit on whole texts: in each, the window that scores highest stands for the text.

    The first column of both tables starts as the log odds of the word or gram between labels.
    """
    net = Network(seed)
    if not len(texts) or labels.min() == labels.max():
        net.outb[:] = 4.0 if len(texts) and labels.max() else -4.0
        net.out[:] = 0
        return net
    batch = prepare(texts, TRAIN_STRIDE)
    r = np.random.default_rng(seed)
    owner = np.concatenate([[0], np.cumsum(batch.grams)])
    has = batch.index >= 0
    pairs = np.unique(np.stack([np.broadcast_to(batch.text[:, None], has.shape)[has], batch.index[has]]), axis=1)
    y_of = labels[pairs[0]]

    def odds(keys: np.ndarray, y: np.ndarray, rows: int) -> np.ndarray:
        one = np.bincount(keys[y == 1], minlength=rows) + 0.5
        two = np.bincount(keys[y == 0], minlength=rows) + 0.5
        value = np.log(one / one.sum()) - np.log(two / two.sum())
        return np.clip(value, -4, 4) * (one + two > 4) / 4

    net.words[:, 0] = odds(batch.bucket[pairs[1]], y_of, WORD_ROWS)
    each = ragged(owner[:-1][pairs[1]], batch.grams[pairs[1]])
    net.grams[:, 0] = odds(batch.gram[each], np.repeat(y_of, batch.grams[pairs[1]]), GRAM_ROWS)
    net.grams[:, 0] /= 2
    state = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in net.NAMES}
    step = 0
    for epoch in range(epochs):
        logit = net.logits(batch)
        order = np.lexsort((logit, batch.text))
        last = np.flatnonzero(np.diff(batch.text[order], append=-1))
        chosen = order[last]
        others = r.integers(0, len(batch.text), len(chosen))
        others = others[labels[batch.text[others]] == 0]
        todo = r.permutation(np.concatenate([chosen, others]))
        rate = 0.01 if epoch < epochs - 2 else 0.003
        for i in range(0, len(todo), 96):
            some = todo[i : i + 96]
            index = batch.index[some]
            used, local = np.unique(index, return_inverse=True)
            local = local.reshape(index.shape)
            if used[0] < 0:
                used, local = used[1:], local - 1
            n = batch.grams[used]
            gram = batch.gram[ragged(owner[used], n)]
            x = net.inputs(batch.bucket[used], gram, n)
            y = labels[batch.text[some]].astype(np.float32)
            weight = np.where(y == 1, 1.0, CLEAN_WEIGHT).astype(np.float32)
            g, dx = net.gradients(x, local, y, weight)
            step += 1
            for k in net.NAMES[2:]:
                m, v = state[k]
                _adam(getattr(net, k), g[k], m, v, rate, step)
            # of the tables, only the rows used move
            rows, at = np.unique(batch.bucket[used], return_inverse=True)
            gw = np.zeros((len(rows), DIM), np.float32)
            np.add.at(gw, at, dx[:, :DIM])
            _adam_rows(net.words, rows, gw, state["words"], rate, step)
            rows, at = np.unique(gram, return_inverse=True)
            gg = np.zeros((len(rows), DIM), np.float32)
            np.add.at(gg, at, np.repeat(dx[:, DIM:] / np.sqrt(n)[:, None], n, axis=0))
            _adam_rows(net.grams, rows, gg, state["grams"], rate, step)
    return net


def _adam(p, g, m, v, rate, step):
    m += 0.1 * (g - m)
    v += 0.001 * (g * g - v)
    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)


def _adam_rows(p, rows, g, state, rate, step):
    m, v, part = state[0][rows], state[1][rows], p[rows]
    _adam(part, g, m, v, rate, step)
    state[0][rows], state[1][rows], p[rows] = m, v, part


def score_texts(net: Network, texts: list[str]) -> np.ndarray:
    """The highest probability among the windows that start at any word of each text.

    Texts of fewer words than a window have one window, as ``prepare`` makes it.
    """
    words, number, bucket, gram, length = features(texts)
    gates = net.gates(net.inputs(bucket, gram, length))
    n = np.diff(words.first)
    best = np.full(len(texts), -np.inf)
    full = np.flatnonzero(n >= WINDOW)
    if len(full):
        starts = n[full] - WINDOW + 1
        runs = -(-starts // _RUN)
        skip = _RUN * ragged(np.zeros(len(full), np.int64), runs)
        logit = net.every_start(
            gates, number, np.repeat(words.first[full], runs) + skip, np.minimum(np.repeat(starts, runs) - skip, _RUN)
        )
        best[full] = np.maximum.reduceat(logit, np.cumsum(runs) - runs)
    short = np.flatnonzero(n < WINDOW)
    place = words.first[short][:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < n[short][:, None]
    number = np.append(number, 0)
    index = np.where(inside, number[np.minimum(place, len(number) - 1)], -1)
    for i in range(0, len(short), _BATCH_WINDOWS):
        some = index[i : i + _BATCH_WINDOWS]
        best[short[i : i + _BATCH_WINDOWS]] = net.pool(net.walk(gates, some), some)[0]
    return 1 / (1 + np.exp(-best))


def _scorer(net: Network, text_at: int, name: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = enumerate(some.column(text_at).to_pylist())
                score = np.concatenate([score_texts(net, t) for _, t in by_bytes(texts, 1_000_000)])
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(score)], names=[*some.schema.names, name])

    return run


def with_score(rows: DataFrame, text_col: str, net: Network) -> DataFrame:
    """The rows with a score as their last column; every text is scored where it is read."""
    schema = T.StructType([*rows.schema.fields, T.StructField(own_name(rows, "score"), T.DoubleType())])
    return spread(rows).mapInArrow(_scorer(net, rows.columns.index(text_col), schema.names[-1]), schema)


def crc_of(column) -> F.col:
    return F.crc32(F.encode(column.cast("string"), "UTF-8"))


def training_sample(docs: DataFrame, labels: DataFrame, toxic: int, clean: int, chars: int) -> tuple[list[str], np.ndarray]:
    """At most ``toxic`` and ``clean`` rows of each label, in the order of a hash of their ids.

    Ids and lengths are joined with the labels; only the chosen rows' texts are fetched.
    """
    known = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    short = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= chars)
    rows = short.select("doc_id").join(known.hint("merge"), "doc_id").select("doc_id", "toxic", F.xxhash64("doc_id").alias("h"))
    parts = [rows.where(F.col("toxic") == y).orderBy("h", "doc_id").limit(n) for y, n in ((1, toxic), (0, clean))]
    chosen = {r["doc_id"]: r["toxic"] for r in parts[0].unionByName(parts[1]).collect()}
    texts = short.where(F.col("doc_id").isin(list(chosen))).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = sorted(texts.limit(toxic + clean).collect()) if chosen else []
    return [r["text"] for r in found], np.array([chosen[r["doc_id"]] for r in found], np.int64)


def fitted(docs: DataFrame, labels: DataFrame, toxic: int, clean: int, chars: int, epochs: int) -> Network:
    held_out = F.coalesce(crc_of(F.col("doc_id")) % 4 == 2, F.lit(False))
    tables = labels.select(F.col("doc_id").cast("bigint"), F.col("toxic").cast("int"))
    texts, y = training_sample(docs.where(~held_out), tables.where(~held_out), toxic, clean, chars)
    return train(texts, y, epochs)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = THRESHOLD,
    train_toxic: int = TRAIN_TOXIC,
    train_clean: int = TRAIN_CLEAN,
    train_chars: int = TRAIN_CHARS,
    epochs: int = EPOCHS,
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Labels (doc_id, toxic) of documents whose crc32 of the id's text is 2 modulo 4 are not
    learned from; null and other labels are ignored, and a document labelled both ways counts
    as toxic. The network is fitted on the driver on a bounded sample: ``train_toxic`` and
    ``train_clean`` rows, texts of at most ``train_chars`` characters. It reads the text only.
    A score is the highest over all windows of 32 words of the whole text, one from every word
    that 31 words follow. Null and empty
    texts have one window without words. Rows are scored one by one, so repeated rows, ties
    and null ids (held_out false) need no rule; without labels all scores are equal and low.
    """
    own = docs.select(F.col("doc_id").cast("bigint"), F.col("text"))
    net = fitted(own, labels, train_toxic, train_clean, train_chars, epochs)
    return with_score(own, "text", net).select(
        "doc_id",
        F.coalesce(crc_of(F.col("doc_id")) % 4 == 2, F.lit(False)).alias("held_out"),
        F.col("score"),
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not rejected, with all their columns, whatever their names.

    Null texts are scored as empty ones; repeated rows and rows without an id are judged like any other.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    own = docs.select(F.col("doc_id").cast("bigint"), F.col("text"))
    net = fitted(own, labels, TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS, EPOCHS)
    return with_score(docs, "text", net).where(F.col(own_name(docs, "score")) < THRESHOLD).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
