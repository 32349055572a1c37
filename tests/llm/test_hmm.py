import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from mixdetect.llm import hmm


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def test_forward_is_the_sum_over_all_paths():
    rng = np.random.default_rng(0)
    p = hmm.HmmParams(states=3)
    model = hmm.Model.initial(np.arange(5.0), p)
    model.move = rng.dirichlet(np.ones(3), 3)
    seqs = [rng.integers(0, 5, n) for n in (1, 4, 6, 2, 6)]
    got = hmm.forward(model, seqs)
    for s, g in zip(seqs, got):
        total = 0.0
        for path in np.ndindex(*[3] * len(s)):
            q = model.start[path[0]] * model.emit[s[0], path[0]]
            for a, b, x in zip(path, path[1:], s[1:]):
                q *= model.move[a, b] * model.emit[x, b]
            total += q
        assert g == pytest.approx(math.log(total), rel=1e-12)
    assert hmm.forward(model, [np.zeros(30_000, dtype=int)])[0] < -1000  # scaled: no underflow


def test_expected_counts_by_enumeration():
    rng = np.random.default_rng(1)
    model = hmm.Model.initial(np.arange(4.0), hmm.HmmParams(states=2))
    model.move = rng.dirichlet(np.ones(2), 2)
    model.inner = np.array([0.3, 0.7])
    segs, first = [rng.integers(0, 4, n) for n in (3, 1, 5)], np.array([True, True, False])
    sums = {"emit": np.zeros((4, 2)), "move": np.zeros((2, 2)), "start": np.zeros(2), "inner": np.zeros(2), "loglik": np.zeros(1)}
    hmm.expected(model, segs, first, sums)
    emit, move, ll = np.zeros((4, 2)), np.zeros((2, 2)), 0.0
    for s, f in zip(segs, first):
        paths = {}
        for path in np.ndindex(*[2] * len(s)):
            q = (model.start if f else model.inner)[path[0]] * model.emit[s[0], path[0]]
            for a, b, x in zip(path, path[1:], s[1:]):
                q *= model.move[a, b] * model.emit[x, b]
            paths[path] = q
        z = sum(paths.values())
        ll += math.log(z)
        for path, q in paths.items():
            for k, x in enumerate(s):
                emit[x, path[k]] += q / z
            for a, b in zip(path, path[1:]):
                move[a, b] += q / z
    assert np.allclose(sums["emit"], emit) and np.allclose(sums["move"], move) and sums["loglik"][0] == pytest.approx(ll)
    assert sums["start"].sum() == pytest.approx(2) and sums["inner"].sum() == pytest.approx(1)


@pytest.mark.parametrize("head", [262_144, 40])  # 40: most words meet their counts in the join
def test_base_scores(frame, prose, clashing, monkeypatch, head):
    monkeypatch.setattr(hmm, "HEAD_WORDS", head)
    monkeypatch.setattr(hmm, "HEAD_WORD_BYTES", 8)
    rows = [(k if k != 5 else None, prose(random.Random(k).randint(0, 80)).title() if k % 3 else prose(20)) for k in range(120)]
    rows += [(200, None), (201, ""), (202, "x" * 5000), (203, "x" * 5000 + " new-word"), (7, rows[7][1]), (204, "w " * 9000)]
    out = hmm.score(clashing(frame(rows)), params=hmm.HmmParams(states=2, symbols=30, rounds=2)).collect()
    counts = Counter()
    for i, t in rows:
        if not held(i):
            counts.update((t or "").encode().lower().split())
            counts["end"] += 1
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        tokens = [*(t or "").encode().lower().split(), "end"]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        want.append((str(i), held(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 6)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out]
    assert sorted(got) == sorted(want)
    assert all(r.score < 0 for r in out)


def test_is_a_distribution(frame):
    """Over all texts of one word (known, known by class, unseen as one) times the end, probabilities stay below one."""
    rows = [(k, " ".join(["a", "b", "c", "dd", "ee"][: 1 + k % 5])) for k in range(60)]
    probes = [(1000 + k, w) for k, w in enumerate(["", "a", "b", "c", "dd", "ee", "zz"])]
    out = hmm.score(frame(rows + probes), params=hmm.HmmParams(states=2, symbols=3, rounds=2)).collect()
    total = sum(10 ** r.score for r in out if r.doc_id >= 1000)
    assert 0 < total < 1


def test_learns_topics(frame):
    rng = random.Random(0)
    vocab = [[f"{t}{k}" for k in range(40)] for t in "abcd"]
    rows = [" ".join(rng.choice(vocab[k % 4]) for _ in range(60)) for k in range(300)]
    out = hmm.score(frame(rows), params=hmm.HmmParams(states=4, rounds=8)).toPandas()
    test = out[out.held_out]
    assert test.score.sum() > test.base_score.sum() + 0.3 * test.n_tokens.sum()  # up to log10(4) = 0.6 a token


def test_empty(frame):
    assert hmm.score(frame([])).count() == 0
    only = next(k for k in range(100) if held(k))
    out = hmm.score(frame([(only, "a b")])).collect()
    assert out[0].train_tokens == 0 and out[0].n_known == 0 and out[0].base_score == 0.0
