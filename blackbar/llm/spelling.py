"""Spelling variants: words one edit apart, found in a trie over letter-group counts."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blackbar.llm.common import spread, store
from blackbar.llm.words import ragged, rows_of

MIN_LENGTH, MIN_COUNT, DROP_EVERY, RATIO = 5, 3, 97, 2
# Letters U+0041-U+00FF are dealt to this many groups by their code.
GROUPS = 12
# Words below one upper node of the trie that a task is given.
NODE_WORDS = 50_000
# Rows searched at once, in whole nodes.
BATCH_ROWS = 50_000
# Queries searched at once, pairs verified at once, distinct words counted before they are sent on.
QUERIES, PAIRS, HELD_WORDS = 2_048, 20_000, 200_000
SPAN_BYTES = 1 << 20
# Longer words are verified one pair at a time.
WIDE = 64

# In Latin-1; any other character becomes a question mark, which is no letter either.
_RUN = re.compile(rb"[A-Za-z\xc0-\xff]+")
_GAP = re.compile(rb"[^A-Za-z\xc0-\xff]")


def runs_of(text: str | None, span: int = SPAN_BYTES):
    """Maximal runs of letters, A-Z lower-cased, in lists of about ``span`` characters."""
    data = (text or "").encode("latin-1", "replace")
    start = 0
    while start < len(data):
        end = min(start + span, len(data))
        if end < len(data):
            gap = _GAP.search(data, end)
            end = gap.start() if gap else len(data)
        yield _RUN.findall(data[start:end].lower())
        start = end


def written(run: bytes, seed: int, drop_every: int) -> bytes:
    """The run with one letter deleted if its checksum, continued from ``seed``, asks for it."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % drop_every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counter(drop_every: int, min_length: int):
    def run(batches):
        import pyarrow as pa

        def flush(held: Counter):
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([w.decode("latin-1") for w in held], pa.string()),
                    pa.array(list(held.values()), pa.int64()),
                ],
                names=["word", "n"],
            )

        held: Counter = Counter()
        for doc, text in rows_of(batches):
            seed = zlib.crc32(b"%s:" % ("" if doc is None else str(doc)).encode())
            for runs in runs_of(text):
                for word, n in Counter(runs).items():
                    word = written(word, seed, drop_every)
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield flush(held)
                    held.clear()
        yield flush(held)

    return run


def word_counts(
    docs: DataFrame, id_col: str, text_col: str, drop_every: int, min_length: int, min_count: int
) -> DataFrame:
    rows = spread(docs.select(F.col(id_col), F.col(text_col)))
    counts = rows.mapInArrow(_counter(drop_every, min_length), "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").cast("bigint").alias("n")).where(F.col("n") >= min_count)


# -- the trie ------------------------------------------------------------------------


def group_counts(words: list[bytes], groups: int = GROUPS) -> np.ndarray:
    """How many letters of each group every word has (a row per word)."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    letter = np.frombuffer(b"".join(words), np.uint8) % groups
    owner = np.repeat(np.arange(len(words)), length)
    return np.bincount(owner * groups + letter, minlength=len(words) * groups).reshape(-1, groups)


class Trie:
    """Words by their group, then by the counts of letter group 0, of letter group 1 and so on.

    Of level k, ``keys[k]`` holds (parent node, count) of every node in one sorted number, and
    a node's number is its place there; the roots are the groups. The words of leaf j are
    ``leaf[j]`` to ``leaf[j + 1]`` in the order ``order``.
    """

    def __init__(self, counts: np.ndarray, group: np.ndarray):
        self.most = int(counts.max(initial=0)) + 2
        node = group.astype(np.int64)
        self.keys = []
        for k in range(counts.shape[1]):
            key, node = np.unique(node * self.most + counts[:, k], return_inverse=True)
            self.keys.append(key)
        self.order = np.argsort(node, kind="stable")
        self.leaf = np.searchsorted(node[self.order], np.arange(len(self.keys[-1]) + 1))

    def search(self, wanted: np.ndarray, group: np.ndarray):
        """Pairs (row of ``wanted``, word of its group) whose counts differ by at most one up and one down.

        Depth first: a stack of frontiers, each of searches that stand at nodes of one level
        with what they have left of the surplus and the deficit; the deepest goes on first.
        """
        start = np.arange(len(wanted))
        stack = [(0, start, group.astype(np.int64), np.ones(len(start), bool), np.ones(len(start), bool))]
        while stack:
            level, query, node, more, less = stack.pop()
            if level == len(self.keys):
                first = self.leaf[node]
                size = self.leaf[node + 1] - first
                yield np.repeat(query, size), self.order[ragged(first, size)]
                continue
            keys = self.keys[level]
            for change, allowed in ((1, more), (-1, less), (0, None)):
                some = slice(None) if allowed is None else np.flatnonzero(allowed)
                count = wanted[query[some], level] + change
                key = node[some] * self.most + count
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = (keys[place] == key) & (count >= 0) & (count < self.most)
                if hit.any():
                    stack.append((
                        level + 1,
                        query[some][hit],
                        place[hit],
                        more[some][hit] & (change != 1),
                        less[some][hit] & (change != -1),
                    ))


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether exactly one inserted, deleted or replaced letter makes ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


class Verifier:
    """``one_edit`` for many pairs of (left, right) at once, over words padded with zeros."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.wide = self.length > WIDE
        width = int(self.length[~self.wide].max(initial=0)) + 2
        self.table = np.zeros((len(words), width), np.uint8)
        for k in np.flatnonzero(~self.wide):
            w = words[k]
            self.table[k, : len(w)] = np.frombuffer(w, np.uint8)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        apart = np.abs(self.length[a] - self.length[b])
        slow = self.wide[a] | self.wide[b]
        for k in np.flatnonzero(slow & (apart <= 1)):
            out[k] = one_edit(self.words[a[k]], self.words[b[k]])
        plain = np.flatnonzero(~slow & (apart == 0))
        out[plain] = np.count_nonzero(self.table[a[plain]] != self.table[b[plain]], axis=1) == 1
        other = np.flatnonzero(~slow & (apart == 1))
        short = np.where(self.length[a[other]] < self.length[b[other]], a[other], b[other])
        long = a[other] + b[other] - short
        x, y = self.table[short], self.table[long]
        # equal up to the first difference, and from there on with the long word one ahead
        begun = np.cumsum(x[:, :-1] != y[:, :-1], axis=1) > 0
        out[other] = ~((x[:, :-1] != y[:, 1:]) & begun).any(axis=1)
        return out


def _near_words(groups: int):
    schema = [("word", "string"), ("n_near", "int64"), ("form_n", "int64"), ("form", "string")]

    def settle(rows: list[tuple]):
        import pyarrow as pa

        alone = Counter(r[0] for r in rows)
        rows = [r for r in rows if alone[r[0]] > 1]
        if not rows:
            return None
        node, head, shorter, home, n = (np.array(c) for c in list(zip(*rows))[:5])
        word = [r[5].encode("latin-1") for r in rows]
        node = np.unique(node, return_inverse=True)[1]
        mine = np.flatnonzero(home)
        if not len(mine):
            return None
        counts = group_counts(word, groups)
        trie, verify = Trie(counts[mine], node[mine]), Verifier(word)
        # most frequent first, ties by code points: the first near word is the form
        rank = np.empty(len(word), np.int64)
        by_rank = np.array(sorted(range(len(word)), key=lambda k: (-n[k], word[k])))
        rank[by_rank] = np.arange(len(word))
        near = np.zeros(len(word), np.int64)
        best = np.full(len(word), len(word), np.int64)
        for at in range(0, len(word), QUERIES):
            for query, found in trie.search(counts[at : at + QUERIES], node[at : at + QUERIES]):
                for part in range(0, len(query), PAIRS):
                    a, b = query[part : part + PAIRS] + at, mine[found[part : part + PAIRS]]
                    # pairs of two longer words belong to their own length
                    good = np.minimum(verify.length[a], verify.length[b]) == shorter[a]
                    a, b = a[good], b[good]
                    good = verify.near(a, b)
                    a, b = a[good], b[good]
                    # pairs with one beginning have met under it, not only under their end
                    half = (shorter[a] // 2).tolist()
                    met = [word[x][:h] == word[y][:h] for x, y, h in zip(a.tolist(), b.tolist(), half)]
                    good = head[a] | ~np.array(met, bool)
                    a, b = a[good], b[good]
                    np.add.at(near, a, 1)
                    np.minimum.at(best, a, rank[b])
        some = np.flatnonzero(near)
        form = by_rank[best[some]]
        columns = [[word[k].decode("latin-1") for k in some.tolist()], near[some], n[form]]
        columns.append([word[k].decode("latin-1") for k in form.tolist()])
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, (_, t) in zip(columns, schema)], names=[name for name, _ in schema]
        )

    def run(batches):
        held: list[tuple] = []
        for row in rows_of(batches):
            if len(held) >= BATCH_ROWS and row[0] != held[-1][0]:
                done = settle(held)
                if done is not None:
                    yield done
                held = []
            held.append(row)
        done = settle(held) if held else None
        if done is not None:
            yield done

    return run


def _group_vector(groups: int):
    """How many letters of each group the column ``word`` has, as an array."""
    letters = F.transform(F.split("word", ""), lambda c: F.ascii(c) % groups)
    return F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.size(F.filter(letters, lambda x: x == g)))


def _probes(depth: int) -> list[tuple[int, ...]]:
    """All changes of ``depth`` counts by at most one up and one down; the first is none."""
    changes = {(0,) * depth}
    for up in range(-1, depth):
        for down in range(-1, depth):
            change = [0] * depth
            if up >= 0:
                change[up] += 1
            if down >= 0:
                change[down] -= 1
            changes.add(tuple(change))
    return sorted(changes, key=lambda c: (any(c), c))


def _halves(min_length: int):
    """Where a word looks for near words: (head, shorter, half) for both halves and both lengths.

    One edit leaves the first half or the rest of the shorter word of a pair as it is; a word
    may be the shorter one, of its own length, or the longer one, of a length less.
    """
    length = F.length("word")

    def of(shorter):
        half = F.floor(shorter / 2).cast("int")
        word = F.col("word")
        return [
            F.struct(F.lit(True).alias("head"), shorter.alias("shorter"), F.substr(word, F.lit(1), half).alias("half")),
            F.struct(
                F.lit(False).alias("head"), shorter.alias("shorter"),
                F.substr(word, length - (shorter - half) + 1).alias("half"),
            ),
        ]

    return F.filter(F.array(*of(length), *of(length - 1)), lambda h: h["shorter"] >= min_length)


def near_words(
    words: DataFrame, min_length: int = MIN_LENGTH, groups: int = GROUPS, node_words: int = NODE_WORDS
) -> DataFrame:
    """Of (word, n), those with a near word: word, n_near, form_n, form (the most frequent near word)."""
    halves = store(words.select("word", "n", F.inline(_halves(min_length))), "halves")
    vectors = halves.withColumn("vector", _group_vector(groups))
    depth = 0  # the fewest upper levels below whose nodes at most node_words words lie
    while depth < groups:
        node = [F.col(c) for c in ("head", "shorter", "half")]
        if depth:
            node.append(F.slice("vector", 1, depth).alias("upper"))
        if (vectors.groupBy(*node).count().agg(F.max("count")).first()[0] or 0) <= node_words:
            break
        depth += 1
    upper = [F.element_at("vector", k + 1) for k in range(depth)]
    probes = F.array(*[
        F.struct(
            F.array(*[u + c for u, c in zip(upper, change)]).cast("array<int>").alias("upper"),
            F.lit(not any(change)).alias("home"),
        )
        for change in _probes(depth)
    ])
    sent = vectors.select("word", "n", "head", "shorter", "half", F.inline(probes)).where("forall(upper, c -> c >= 0)")
    name = F.concat_ws(":", F.when(F.col("head"), "head").otherwise("end"), "shorter", "half", F.concat_ws(",", F.col("upper").cast("array<string>")))
    found = (
        sent.select(name.alias("node"), "head", "shorter", "home", "n", "word")
        .repartition("node").sortWithinPartitions("node")
        .mapInArrow(_near_words(groups), "word string, n_near bigint, form_n bigint, form string")
    )
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").cast("bigint").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.m")).alias("form_n"), F.col("best.form").alias("form")
    )


def roots(forms: DataFrame, rounds: int = 60) -> DataFrame:
    """The last word from (word, form) on, by doubling the stretch each round; forms have no cycle."""
    links = store(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = store(links.join(ahead, "root", "left"), "roots")
        if step.where("next is not null").isEmpty():
            return links
        links = step.select("word", F.coalesce("next", "root").alias("root"))
    raise RuntimeError(f"forms did not end in {rounds} rounds")


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    drop_every: int = DROP_EVERY,
    ratio: int = RATIO,
    groups: int = GROUPS,
    node_words: int = NODE_WORDS,
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Runs of ``[A-Za-z\\u00C0-\\u00FF]`` are lower-cased (A-Z only) and lose a letter where the
    checksum of id and run is a multiple of ``drop_every``. Words of at least ``min_length``
    letters and ``min_count`` occurrences are filed under each of their halves, one of which
    an edit leaves alone; below a half they form a trie by the counts of their letter groups.
    Halves are keys of the shuffle, and so are upper levels of the trie where more than
    ``node_words`` words share a half: then every word visits the upper nodes that one surplus
    and one deficit reach. It is searched depth first in what lies below. Leaf words are
    verified and reduced to a count and the best one in the task, so no pairs are sent on.

    ``form`` is the most frequent near word (ties: first in code-point order) if it occurs at
    least ``ratio`` times as often, ``root`` the last word that forms lead to. Null texts have
    no runs, a null id counts as empty text; repeated rows count as often as they come. An
    empty table gives no rows; only the two named columns are read. Texts are taken apart in
    spans, so they may be long; words may be as well. With ``groups`` upper levels a node's
    words are anagrams by group, which are then gathered whatever their number.
    """
    if min_length < 2:
        raise ValueError("min_length must be at least 2")
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    words = store(word_counts(docs, id_col, text_col, drop_every, min_length, min_count), "words")
    near = store(near_words(words, min_length, groups, node_words), "near")
    rows = words.join(near, "word", "left").withColumn(
        "form", F.when(F.col("form_n") >= ratio * F.col("n"), F.col("form"))
    )
    rows = store(rows, "forms")
    last = roots(rows.where("form is not null"))
    return rows.join(last, "word", "left").select(
        "word",
        "form",
        F.coalesce("root", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(F.col("form").isNotNull(), F.col("form_n")).alias("form_n"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
