import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def frame(spark):
    """Documents from texts (or tuples of id and text, source), over a few partitions."""

    def make(rows, parts=3):
        out = []
        for k, r in enumerate(rows):
            i, t, s = (k, r, f"s{k % 2}") if not isinstance(r, tuple) else (*r, f"s{k % 2}")[:3] if len(r) == 2 else r
            out.append((i, t, "en", s, None if t is None else len(t)))
        return spark.createDataFrame(out, DOCS).repartition(parts)

    return make


@pytest.fixture
def clashing():
    """Adds columns whose names the operators use for their own results."""

    def add(df):
        names = ["size", "target", "taken", "fp", "fingerprint", "component_id", "kept", "k1", "k2", "a", "f", "n", "word", "c", "rid",
                 "spans", "length", "n_docs", "shard", "node", "root", "u", "v", "row", "y", "id", "item_id", "covered", "copies", "weight",
                 "__k1", "__k2", "__s1", "__m1", "__c1", "__n", "__one", "__row", "__t", "__text", "__new", "__spans", "__i", "__copies"]
        return df.withColumns({x: F.lit("x") for x in names if x not in df.columns})

    return add


@pytest.fixture
def prose():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 9))) for _ in range(400)]

    def make(n, seed=None):
        r = random.Random(seed) if seed is not None else rng
        return " ".join(r.choice(words) for _ in range(n))

    return make
