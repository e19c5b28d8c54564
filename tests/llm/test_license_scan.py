import random
import re

from blackbar.llm import license_scan as M


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]


def model(rows):
    """Best containment over all windows, as the docstring has them."""
    out = {}
    for i, text in rows:
        s = shingles(text)
        for name, _, notice in M.TEMPLATES:
            t = set(shingles(notice))
            stride = 1
            while stride < max(len(shingles(notice)) - 1, 1):
                stride *= 2
            for first in range(0, len(s), stride):
                part = len(t & set(s[first : first + 2 * stride])) / len(t)
                if part >= 0.8:
                    best, at, n = out.get((str(i), name), (0, 0, 0))
                    if (part, -first) > (best, -at):
                        best, at = part, first
                    out[str(i), name] = (best, at, n + 1)
    return out


def texts():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    rows = [(0, None), (1, ""), (2, "Licensed under"), (3, M.TEMPLATES[0][2]), (None, M.TEMPLATES[1][2]), (3, M.TEMPLATES[1][2])]
    for i in range(10, 90):
        w = [word() for _ in range(r.randint(0, 80))]
        notice = r.choice(M.TEMPLATES)[2].split()
        kind = r.random()
        if kind < 0.3 and len(notice) > 12:  # a changed word, sometimes near enough
            notice[r.choice([0, 1, len(notice) - 1, len(notice) // 2])] = word()
        if kind < 0.8:
            at = r.randint(0, len(w))
            w[at:at] = notice
        rows.append((i, r.choice([" ", "\n", " - "]).join(w)))
    rows.append((200, " ".join(word() for _ in range(8000)) + " " + M.TEMPLATES[5][2].upper()))
    return rows


def test_matches_equal_brute_force(docs):
    got = {(str(r.doc_id), r.license): (r.containment, r.first_word, r.n_windows) for r in M.license_scan(docs(texts())).collect()}
    want = model([(i, t) for i, t in texts() if i != 3])
    assert {k: v for k, v in got.items() if k[0] != "3"} == want
    assert {k for k in got if k[0] == "3"} == {("3", "Apache-2.0"), ("3", "MIT")}


def test_bands_make_a_miss_unlikely():
    assert M.collision_probability() > 0.99999


def test_no_python_in_the_plan(docs):
    plan = M.license_scan(docs([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(docs):
    assert M.license_scan(docs([])).collect() == []
