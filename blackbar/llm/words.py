"""White-space words of many texts at once, as numpy arrays over one byte buffer."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from blackbar.llm.common import mix64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 texts, none of which reaches into another text.

    data: all texts with a line break after each; start, end: where each word lies in it;
    first: of each text, the number of its first word (one more entry at the end);
    hash: a 64-bit hash of each word's bytes, the same in every process.
    """

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts) + b"\n"
        self.bytes = np.frombuffer(self.data, np.uint8)
        space = _SPACE[self.bytes]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        self.start, self.end = edge[0::2], edge[1::2]
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)])
        self.first = np.searchsorted(self.start, begins)
        self.hash = self._hash(space)

    def __len__(self) -> int:
        return len(self.start)

    def _hash(self, space: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        powers = np.full(int(length.max()), _STEP, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        at = np.cumsum(length) - length
        place = np.arange(int(length.sum()), dtype=np.int64)
        place -= np.repeat(at, length)
        value = _BYTE[self.bytes[~space]]
        value *= powers[place]
        return mix64(np.add.reduceat(value, at) + length.astype(np.uint64))

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each distinct word one place, and for each word the number of its distinct word."""
        _, place, number = np.unique(self.hash, return_index=True, return_inverse=True)
        return place, number

    def slices(self, places: np.ndarray) -> list[bytes]:
        return [self.data[a:b] for a, b in zip(self.start[places].tolist(), self.end[places].tolist())]


def by_bytes(rows: Iterable[tuple[object, str | None]], most: int = 2_000_000) -> Iterator[tuple[list, list[str]]]:
    """Rows (key, text) in lists of about ``most`` bytes; a longer text is a list of its own."""
    keys: list = []
    texts: list[str] = []
    size = 0
    for key, text in rows:
        text = text or ""
        if texts and size + len(text) > most:
            yield keys, texts
            keys, texts, size = [], [], 0
        keys.append(key)
        texts.append(text)
        size += len(text) + 1
    if texts:
        yield keys, texts


def rows_of(batches: Iterable) -> Iterator[tuple]:
    """The rows of Arrow batches, a few at a time as Python values."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns))


def ragged(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices first[i], first[i] + 1, ... of every i, length[i] of them, one after another."""
    if not len(first):
        return np.zeros(0, np.int64)
    at = np.cumsum(length) - length
    return np.arange(int(length.sum()), dtype=np.int64) + np.repeat(first - at, length)
