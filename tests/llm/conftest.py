import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "ré", "so") for b in ("ta", "ve", "x", "zu", "ñi")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source, n_chars): nulls, empty, very long, copies, near copies, shared passages, repeats."""
    base, shared, r = prose(1, 120), prose(2, 60), random.Random(3)
    out = [(0, None, "en", "a", 0), (1, "", None, None, 0), (2, " \n\t ", "en", "b", 1), (3, "one", "en", "a", 3), (4, "one", "de", "a", 3), (5, prose(9, 20_000), "en", "a", 0)]
    for i in range(6, 26):  # near copies
        w = base.split()
        w[r.randrange(len(w))] = f"w{i}"
        out.append((i, " ".join(w), "en", "a", 1))
    out += [(i, base, "en", "a", 1) for i in range(26, 30)]
    out += [(i, f"{prose(i, 70)}\n{shared} {prose(i + 100, 30)}", "fr", "c", 2) for i in range(30, 40)]
    out += [(40, "x " * 40, "en", None, 1), (41, "A b\x0bC d E f", "en", "b", 1), (41, "A b\x0bC d E f", "en", "b", 1), (None, base, "en", "a", 1), (42, shared, "en", "d", 1), (43, "lo " * 3000, "en", "e", 9)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows over several partitions, with columns whose names clash with those that operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.withColumns({c: F.lit(1) for c in ("part", "kind", "id", "n", "cls", "rk", "m", "size", "label", "host", "key", "shard", "spans", "words", "_text")})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
