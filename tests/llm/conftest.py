import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, id long, row long, score double"


def texts(seed: int = 7, n: int = 30) -> list[str]:
    """Pseudo-random texts with exact copies, near copies, shared lines and odd ones."""
    r = random.Random(seed)
    words = [a + b for a in ("ka", "lo", "mi", "nu", "re", "ti", "so") for b in ("n", "r", "st", "ve", "la", "do")]
    line = lambda k: " ".join(r.choice(words) for _ in range(k))
    shared = line(14)
    out = []
    for i in range(n):
        t = [line(r.randint(6, 40)) for _ in range(r.randint(1, 5))]
        if i % 4 == 0:
            t.insert(0, shared)
        out.append("\n".join(t))
    long = out[3].split(" ")
    near = list(long)
    near[len(near) // 2] = "changed"
    out += [out[0], out[0], out[1].upper(), " ".join(near), shared + "x", shared[:-1], "", " \n\t ", "a", "a b c", "a  b\nc", "x" * 50_000, "word " * 5_000, "é漢🙂 ünï " * 40]
    return out


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source): nulls in every column, repeated rows, a repeated id."""
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts())]
    rows += [(None, rows[2][1], "en", "s0"), (None, None, None, None), (900, None, "en", None), rows[5], rows[5], (5, "another text under a used id with some more words in it", None, "s1")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows as a table whose other columns have names that operators use inside."""
    return spark.createDataFrame([(*r, len(r[1] or ""), -1, -2, -3, 0.5) for r in odd_rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
