import tracemalloc
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from blackbar.llm import packing as M

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "It's a TEST, isn't it?! 123 ½ x²", "naïve Ångström café", "日本語 text Σς İstanbul", "a\x1cb\x85c\xa0d",
    "<|endoftext|> special", "__init__ don't 'S 'Re", "word " * 5000, "ǅ ʰ ﬁ", "́ lone", "tab\tnew\nline\r\n",
]


def whole(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_word_ids_equal_the_tokenizers():
    tokenizer = Tokenizer.from_file(PATH)
    texts = [t or "" for t in ODD]
    for got, text in zip(M.word_ids(PATH).ids(texts), texts):
        assert got.tolist() == whole(tokenizer, text).tolist(), text


def check_pieces(rows, ids, size):
    pieces, sequences = {}, {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        assert r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for i, parts in pieces.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[i])
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


def test_pieces_cover_every_document(docs, words):
    rows = list(enumerate(ODD + words(150)))
    tokenizer = Tokenizer.from_file(PATH)
    ids = {i: np.append(whole(tokenizer, t), M.END_ID).astype("<u4") for i, t in rows}
    for size in (64, 2048):
        got = M.pack_documents(docs(rows).coalesce(1), size=size, block_tokens=3000).collect()
        n = check_pieces(got, ids, size)
        total = sum(map(len, ids.values()))
        assert n * size - total < size * (total // 3000 + 10)


def test_descending_documents_go_to_the_cheapest_sequence():
    lengths = np.array([5, 9, 3, 3, 25])
    pieces = M.pack(lengths, 10, 1.0, 1.0)
    assert [p for p in pieces if p[0] == 4][:2] == [(4, 0, 10, 0, 0), (4, 10, 10, 1, 0)]
    fill, cost = {}, {}
    rest = [p for p in pieces if p[3] >= 2]
    for d, _, n, s, at in rest:
        assert at == fill.get(s, 0)
        room = [q for q in range(2, 5) if 10 - fill.get(q, 0) >= n]
        assert cost.get(s, 0) == min(cost.get(q, 0) for q in room)
        fill[s] = fill.get(s, 0) + n
        cost[s] = cost.get(s, 0) + n + n * n
    assert sum(fill.values()) == 5 + 9 + 3 + 3 + 5


def test_balance_against_first_fit():
    r = np.random.default_rng(3)
    lengths = r.geometric(1 / 300, 800)
    pieces = M.pack(lengths, 2048, 1.0, 1 / 2048)
    cost = np.zeros(max(p[3] for p in pieces) + 1)
    first = np.zeros(len(cost))
    for _, _, n, s, _ in pieces:
        cost[s] += n + n * n / 2048
    room, order = np.full(len(cost), 2048), np.argsort(-lengths)
    for n in lengths[order]:
        while n > 0:
            s = int(np.argmax(room >= min(n, room.max())))
            k = min(int(n), int(room[s]))
            room[s] -= k
            first[s] += k + k * k / 2048
            n -= k
    assert cost.std() < first.std()


def test_empty_and_null(docs):
    assert M.pack_documents(docs([])).collect() == []
    got = M.pack_documents(docs([(None, None), (7, ""), (7, "")])).collect()
    assert sorted(str(r.doc_id) for r in got) == ["7", "7", "None"]
    assert all(r.length == r.doc_tokens == 1 for r in got)


def test_known_words_are_found_again_and_forgotten_in_time(words, monkeypatch):
    tokenizer = Tokenizer.from_file(PATH)
    texts = [t or "" for t in ODD] + [t or "" for t in words(60)] + ["a,b 'sab ''s x.y, ' \" ''", "word, word", "word"]
    for limit in (500_000, 5):
        monkeypatch.setattr(M, "_CACHE_WORDS", limit)
        ids = M.WordIds(PATH)
        for _ in range(2):
            for at in range(0, len(texts), 7):
                for got, text in zip(ids.ids(texts[at : at + 7]), texts[at : at + 7]):
                    assert got.tolist() == whole(tokenizer, text).tolist(), text
        assert np.all(np.diff(ids.known.astype(object)) > 0)


def test_a_known_word_takes_little_memory():
    ids = M.WordIds(PATH)
    ids.ids(["warm up"])
    text = " ".join(f"{a}{b}{c}x" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst" for c in "abcdefghijklmnopqrst")
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        ids.ids([text])
        held = tracemalloc.get_traced_memory()[0] - before
    finally:
        tracemalloc.stop()
    assert held < 8000 * 80
