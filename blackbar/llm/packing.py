"""Packing tokenised documents into training sequences of balanced attention cost."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blackbar.llm.common import spread
from blackbar.llm.words import Words, by_bytes, ragged, rows_of

MAX_TOKENS = 2048
# Tokens that are packed together. Each block leaves less than one sequence of padding.
BLOCK_TOKENS = 1 << 20
END_ID = 1
# Text whose words are looked up together; the arrays of that take about 40 times as much.
BATCH_BYTES = 600_000
_CACHE_WORDS = 500_000

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, cost double"
)

# Texts of these characters are split into words here and only new words go to the tokenizer;
# any other text goes to the tokenizer whole. Both ways give the same ids.
_OTHER = re.compile("[^\t-\r -~\x85\xa0-\u012f\u0132-\u024f]")
_CONTROL = re.compile("[\x1c-\x1f]")
_WORDS = re.compile(
    r"[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|'s|'t|'re|'ve|'m|'ll|'d|(?:[^\s\w]|_)+"
)


class WordIds:
    """Ids of texts; every distinct word is encoded once, until there are too many.

    Words are known by the hash of ``Words`` in sorted arrays, so a known one costs no object.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        # hash of each known word; where its ids begin in ``flat``, and their number
        self.known = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.flat = np.zeros(0, "<u4")

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words are encoded many at a time; the last token of each is marked as a word's end."""
        ids, lengths = [], []
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            ids.append(self._encode(b" ".join(some).decode()))
            lengths.append(np.diff(np.flatnonzero(self.ends[ids[-1]]) + 1, prepend=0))
            if len(lengths[-1]) != len(some) or int(lengths[-1].sum()) != len(ids[-1]):
                raise ValueError("the tokenizer does not end every word")
        return np.concatenate(ids), np.concatenate(lengths)

    def _unknown(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, hashes)
        found = at < len(self.known)
        found[found] = self.known[at[found]] == hashes[found]
        return np.flatnonzero(~found)

    def _learn(self, hashes: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        """Sorted hashes that are not known yet, and the ids of their words one after another."""
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.begin = np.insert(self.begin, at, len(self.flat) + np.cumsum(length) - length)
        self.length = np.insert(self.length, at, length)
        self.flat = np.concatenate([self.flat, ids])

    def _find(self, words: Words, split: bool) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word begin in ``flat``, and their number."""
        place, number = words.distinct()
        hashes = words.hash[place]
        new = self._unknown(hashes)
        if len(new) and not split:
            self._learn(hashes[new], *self._encode_words(words.slices(place[new])))
        elif len(new):
            parts = [
                [x] if x.isalpha() else [w.encode() for w in _WORDS.findall(x.decode())]
                for x in words.slices(place[new])
            ]
            begin, length = self._find(Words([b" ".join([w for p in parts for w in p])]), False)
            # a word of one part is known by now; others are joined from their parts
            n = np.array([len(p) for p in parts], np.int64)
            joined = n != 1
            several = np.repeat(joined, n)
            begin, length, n = begin[several], length[several], n[joined]
            upto = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(n)])]
            self._learn(hashes[new[joined]], self.flat[ragged(begin, length)], np.diff(upto))
        at = np.searchsorted(self.known, hashes)[number]
        return self.begin[at], self.length[at]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        plain: list[bytes] = []
        places: list[int] = []
        for i, text in enumerate(texts):
            if not text.isascii():
                if _OTHER.search(text):
                    out[i] = self._encode(text)
                    continue
                if not unicodedata.is_normalized("NFC", text):
                    text = unicodedata.normalize("NFC", text)
                text = text.replace("\x85", " ").replace("\xa0", " ")
            if "<|" in text or _CONTROL.search(text):
                out[i] = self._encode(text)
                continue
            plain.append(text.lower().encode())
            places.append(i)
        if plain:
            words = Words(plain)
            if len(self.known) > _CACHE_WORDS:
                self._forget()
            begin, length = self._find(words, True)
            ids = self.flat[ragged(begin, length)]
            upto = np.concatenate([[0], np.cumsum(length)])[words.first]
            for i, a, b in zip(places, upto.tolist(), upto[1:].tolist()):
                out[i] = ids[a:b]
        return out


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def pack(lengths: np.ndarray, size: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) for documents of these token counts.

    A piece of n tokens costs ``linear * n + quadratic * n * n``, as attention stays within a
    document. Full sequences are cut from long documents first. What is left is assigned in
    descending length to the sequence of lowest cost that has room for it; when none has room,
    it is cut to fill the cheapest open sequences. As many sequences are opened as the tokens
    need, so less than one sequence is padded.
    """
    pieces, sequence = [], 0
    rest = []
    for d in np.argsort(-lengths, kind="stable").tolist():
        n, start = int(lengths[d]), 0
        while n - start >= size:
            pieces.append((d, start, size, sequence, 0))
            start += size
            sequence += 1
        if n > start:
            rest.append((n - start, d, start))
    total = sum(n for n, _, _ in rest)
    if not total:
        return pieces
    rest.sort(key=lambda x: (-x[0], x[1]))
    room = np.full(-(-total // size), size, np.int64)
    cost = np.zeros(len(room))
    for n, d, start in rest:
        while n:
            able = room >= n
            one = able.any()
            to = int(np.argmin(np.where(able if one else room > 0, cost, np.inf)))
            take = n if one else int(room[to])
            pieces.append((d, start, take, sequence + to, size - int(room[to])))
            room[to] -= take
            cost[to] += linear * take + quadratic * take * take
            n -= take
            start += take
    return pieces


def _packer(path: str, size: int, block: int, linear: float, quadratic: float):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from blackbar.llm import packing as P

        words = P.word_ids(path)
        end = P.END_ID
        part = TaskContext.get().partitionId()
        first = 0
        ids: list[int | None] = []
        tokens: list[bytes] = []
        held = 0

        def flush():
            nonlocal first, held
            lengths = np.array([len(t) // 4 for t in tokens], np.int64)
            pieces = P.pack(lengths, size, linear, quadratic)
            d, start, length, seq, off = (np.array(x, np.int64) for x in zip(*pieces))
            crc = [zlib.crc32(tokens[i][4 * s : 4 * (s + n)]) for i, s, n in zip(d.tolist(), start.tolist(), length.tolist())]
            base = (part << 40) + first
            first += int(seq.max()) + 1
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in d.tolist()], pa.int64()),
                    pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(lengths[d]),
                    pa.array(seq + base), pa.array(off),
                    pa.array(linear * length + quadratic * length.astype(float) ** 2),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"],
            )
            ids.clear()
            tokens.clear()
            held = 0
            return out

        for keys, texts in by_bytes(rows_of(batches), P.BATCH_BYTES):
            for doc, t in zip(keys, words.ids(texts)):
                ids.append(doc)
                tokens.append(np.append(t, end).astype("<u4").tobytes())
                held += len(t) + 1
                if held >= block:
                    yield flush()
        if tokens:
            yield flush()

    return run


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    size: int = MAX_TOKENS,
    block_tokens: int = BLOCK_TOKENS,
    linear: float = 1.0,
    quadratic: float = 1.0 / MAX_TOKENS,
) -> DataFrame:
    """One row per piece of a document in a sequence of at most ``size`` tokens.

    Every document is its tokens and one closing id, so empty and null texts have one token.
    Each task packs the rows it reads in blocks of ``block_tokens``; nothing is shuffled, and
    per block less than ``size`` tokens of padding arise. Sequence numbers hold the task's
    number in their upper bits, so they are unique and stable when a task is run again. Ties
    in length keep the order of the rows; repeated rows are packed as often as they come; null
    ids are kept. An empty table gives no rows; columns besides the two named are not read.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    rows = spread(docs.select(F.col(id_col).cast("bigint"), F.col(text_col)))
    return rows.mapInArrow(_packer(tokenizer, size, block_tokens, linear, quadratic), SCHEMA)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
