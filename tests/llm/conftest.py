import hashlib
import random

import pytest

from blackbar.llm.common import ship


@pytest.fixture(scope="session")
def llm(spark):
    ship(spark)
    return spark


@pytest.fixture
def sha():
    return lambda text: hashlib.sha256((text or "").encode()).hexdigest()


@pytest.fixture
def docs(llm):
    """A table of (doc_id, text) rows with columns whose names clash with those of the operators."""

    def make(rows):
        return llm.createDataFrame(
            [(i, t, 1, "x", None) for i, t in rows],
            "doc_id bigint, text string, kept int, component_id string, fingerprint bigint",
        )

    return make


@pytest.fixture
def words():
    """Random texts over a small vocabulary, with copies, near copies, nulls and a long one."""

    def make(n, seed=1, vocabulary=400, length=60):
        r = random.Random(seed)
        pool = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 8))) for _ in range(vocabulary)]
        out = []
        for _ in range(n):
            kind = r.random()
            if out and kind < 0.15:
                out.append(r.choice(out))
            elif out and kind < 0.4:
                base = (r.choice(out) or "").split(" ")
                base[r.randrange(len(base))] = r.choice(pool)
                out.append(" ".join(base))
            elif kind < 0.45:
                out.append(r.choice([None, "", " ", "one", "Ünï Cödé\tTWO\n"]))
            else:
                out.append(" ".join(r.choice(pool) for _ in range(r.randint(1, length))))
        out.append(" ".join(r.choice(pool) for _ in range(5000)))
        return out

    return make
