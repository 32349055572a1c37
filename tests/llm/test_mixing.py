import random

import pytest
from pyspark.sql import functions as F

from mixdetect.llm import mixing


def filled(sizes, weights, epochs=3.0):
    """Water filling by bisection of the level."""
    total = sum(sizes)
    low, high = 0.0, 3.0 * total + 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(w * mid, epochs * s) for s, w in zip(sizes, weights)) < total else (low, mid)
    return [min(w * low, epochs * s) for s, w in zip(sizes, weights)]


def test_targets_and_taken(frame, clashing):
    rng = random.Random(3)
    rows = [(k, "w " * rng.randint(0, 60), rng.choice(["b", "a", "é", None, "z", "hot", "hot", "hot"])) for k in range(400)]
    rows += [(1000, "long " * 5000, "hot"), (1001, None, "a"), (1002, "", "empty"), (7, rows[7][1], rows[7][2])]
    out = mixing.mix(clashing(frame(rows))).toPandas()
    assert len(out) == len(rows)
    words = {}
    for _, t, s in rows:
        words[s] = words.get(s, 0) + len((t or "").split())
    order = sorted([s for s in words if s is not None]) + [None]
    want = dict(zip(order, filled([words[s] for s in order], [1 + k % 3 for k in range(len(order))])))
    for s in order:
        part = out[out.source.isna()] if s is None else out[out.source == s]
        assert part.target.iloc[0] == pytest.approx(want[s], rel=1e-9, abs=1e-6)
        assert (part.taken <= 3 * part["size"]).all()
        assert abs(part.taken.sum() - want[s]) <= part["size"].max()
    again = mixing.mix(frame(rows, parts=7)).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert sorted(map(str, again[key].values.tolist())) == sorted(map(str, out[key].values.tolist()))


def test_salted_join_gives_the_same(frame, monkeypatch):
    rows = [(k, "w " * (k % 13), f"s{k % 5}") for k in range(200)]
    one = mixing.mix(frame(rows)).toPandas().sort_values("doc_id").reset_index(drop=True)
    monkeypatch.setattr("mixdetect.llm.common.BROADCAST_ROWS", 0)
    two = mixing.mix(frame(rows)).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert one.equals(two)


def test_empty_and_mixed_rows(frame, clashing):
    assert mixing.mix(frame([])).count() == 0
    assert mixing.mixed_rows(frame([])).count() == 0
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, "d e", "x"), (None, "f g h i", "y"), (None, None, None)]
    docs = clashing(frame(rows))
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    total = mixing.mix(docs).agg(F.sum("copies").alias("n")).first()["n"]
    assert mixed.count() == total


def test_fractional_caps(frame):
    rows = [(k, "one two three four five", "small") for k in range(200)] + [(1000 + k, "word " * 5, "large") for k in range(4000)]
    for cap in (0.5, 2.5):
        got = mixing.mix(frame(rows), max_epochs=cap, weight_cycle=(1.0, 30.0)).collect()
        small = [r for r in got if r.source == "small"]
        assert small[0].target == cap * 1000 and abs(sum(r.taken for r in small) - cap * 1000) <= 5
