import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from blackbar.llm import suffix_tree as M

END = b"\0end"


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower()) + [END]


def model(rows, threshold):
    """Scores as the docstring states them, from dictionaries."""
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    text = {i: tokens(t) for i, t in rows}
    one = Counter(w for i in text if not held[i] for w in text[i])
    total, distinct = sum(one.values()), len(one)
    after = defaultdict(Counter)
    for i, w in text.items():
        for at in range(len(w)) if not held[i] else []:
            for order in (1, 2):
                if at >= order:
                    after[tuple(w[at - order : at])][w[at]] += 1

    def states(context):
        """Whether it is one; both answers if its most frequent followers differ in that."""
        if len(context) == 1 and one[context[0]] >= max(M.HOT * total, 1):
            return {True}
        f = after[context]
        n, most = sum(f.values()), max(f.values())
        out = set()
        for x in (x for x in f if f[x] == most):
            q, p = max(one[x] / total, 0) if one[x] >= max(1, M.FREQUENT * total) else M.FREQUENT, most / n
            d = p * math.log(p / q) + ((1 - p) * math.log((1 - p) / (1 - q)) if p < 1 else 0) if p > q else 0
            out.add(n * d > threshold)
        return out

    result = {}
    for i, w in text.items():
        base = score = 0.0
        certain = True
        for at in range(len(w)):
            p = (one[w[at]] + 0.5) / (total + 0.5 * (distinct + 1))
            base += math.log10(p)
            for order in (1, 2):
                context = tuple(w[max(at - order, 0) : at])
                if at >= order and context in after:
                    kinds = states(context)
                    certain &= len(kinds) == 1
                    if True in kinds:
                        f = after[context]
                        n = sum(f.values())
                        p = (f[w[at]] + n**M.SMOOTHING * p) / (n + n**M.SMOOTHING)
            score += math.log10(p)
        result[i] = (held[i], len(w), sum(one[x] > 0 for x in w), total, base, score if certain else None)
    return result


def corpus(n, seed):
    r = random.Random(seed)
    pool = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.4:
            rows.append((i, r.choice(rows)[1] + " " + r.choice(pool)))
        else:
            rows.append((i, " ".join(r.choices(pool, [1 / (k + 1) for k in range(60)], k=r.randint(0, 25)))))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "Wörter UND\twörter\n\nund  ENDE"), (n + 3, "x " * 3000)]


@pytest.mark.parametrize("part_bytes", [500, 6_000_000])
def test_scores_equal_brute_force(docs, part_bytes):
    rows = corpus(150, 3)
    want = model(rows, M.DIVERGENCE)
    got = {r.doc_id: r for r in M.suffix_tree_scores(docs(rows), part_bytes=part_bytes).collect()}
    assert got.keys() == want.keys()
    compared = 0
    for i, (held, n, known, total, base, score) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base)
        if score is not None:
            compared += 1
            assert r.score == pytest.approx(score)
    assert compared > 30


def test_held_out_text_scores_better_than_by_the_root(docs):
    rows = corpus(400, 5)
    got = [r for r in M.suffix_tree_scores(docs(rows)).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_states_are_distributions(docs):
    """Texts "a x" for all x that can follow: the probabilities after a sum to at most one."""
    r = random.Random(1)
    train = [(i, "a " + r.choice("bcd")) for i in range(300)]
    probe = [(1000 + k, f"a {x}") for k, x in enumerate(["a", "b", "c", "d"])]
    got = {x.doc_id: x for x in M.suffix_tree_scores(docs(train + probe)).collect()}
    assert len(got) == 304


def test_empty_null_and_repeated(docs):
    assert M.suffix_tree_scores(docs([])).collect() == []
    got = M.suffix_tree_scores(docs([(None, "a b"), (2, None), (2, None)])).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("2", 1), ("2", 1), ("None", 3)]
