import hashlib
import random

import numpy as np
import pytest

from mixdetect.llm import repeats
from mixdetect.llm.suffix import sort_suffixes


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for t in raw:
        for p in range(len(t) - 199):
            seen[t[p:p + 200]] = seen.get(t[p:p + 200], 0) + 1
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for p in range(len(t) - 199):
            if seen[t[p:p + 200]] > 1:
                gone[p:p + 200] = b"\1" * 200
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest(), kept))
    return out


def corpus(prose, seed):
    rng = random.Random(seed)
    shared = [prose(rng.randint(20, 120)) for _ in range(8)]
    texts = []
    for _ in range(100):
        s = prose(rng.randint(0, 150))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randint(0, len(p) // 2)
            p = rng.choice([p, p[a:], p[:a + 150], p[a:a + 260]])
            c = rng.randint(0, len(s))
            s = s[:c] + p + s[c:]
        texts.append(s)
    return texts + [None, "", "x" * 199, "x" * 200, "x" * 450, "ab" * 300, "Der " * 200, "Der " * 900, texts[3], texts[3], texts[7],
                    "z" + texts[5], "\0" * 250 + texts[9][:230], "\0" * 260]


@pytest.mark.parametrize("hot", [50_000, 2])  # 2: every anchor that occurs thrice is counted by windows
def test_against_brute_force(frame, prose, clashing, hot):
    texts = corpus(prose, hot)
    want = brute(texts)
    got = {r.doc_id: r for r in repeats.digests(clashing(frame(texts, parts=4)), hot=hot).collect()}
    assert len(got) == len(texts)
    for k, w in enumerate(want):
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == w[:4], k


def test_segments_and_blocks(frame, prose, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 512)
    monkeypatch.setattr(repeats, "BLOCK", 3)
    a, b = prose(900, seed=1), prose(400, seed=2)
    texts = [a[:3000] + b + a[3000:], b + a[:100], prose(100, seed=3), a[2000:2900]]
    raw = [t.encode() for t in texts]
    whole = sorted((t, p) for t, at, _ in repeats.anchors(raw) for t, p in [*zip(t.tolist(), at.tolist())])
    monkeypatch.setattr(repeats, "SEGMENT", 4_000_000)
    assert whole == sorted((t, p) for t, at, _ in repeats.anchors(raw) for t, p in [*zip(t.tolist(), at.tolist())])
    got = {r.doc_id: r.n_removed for r in repeats.digests(frame(texts)).collect()}
    assert [got[k] for k in range(4)] == [w[1] for w in brute(texts)]


def test_remove(frame, prose, clashing):
    texts = corpus(prose, 5)
    docs = clashing(frame([(k if k else None, t) for k, t in enumerate(texts)]))
    out = repeats.remove_repeats(docs, length_col="n_chars")
    assert out.columns == docs.columns
    left = out.collect()
    assert all(r[c] == "x" for r in left for c in ("__k1", "__spans", "__new", "__row"))
    got = {r.doc_id: (r.text, r.n_chars) for r in left}
    for k, (w, t) in enumerate(zip(brute(texts), texts)):
        left = t if w[1] == 0 else w[4].decode("utf-8", "ignore")
        assert got[k if k else None] == (left, None if left is None else len(left)), k
    assert repeats.remove_repeats(frame([])).count() == 0 and repeats.digests(frame([])).count() == 0


def test_sort_against_python():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, w = int(rng.integers(1, 60)), int(rng.choice([1, 5, 8, 24, 25, 60, 136]))
        rows = rng.integers(0, 3, (3, w)).astype(np.uint8)[rng.integers(0, 3, n)].copy()
        for i in range(n):
            if rng.random() < 0.6:
                rows[i, rng.integers(0, w)] = rng.integers(0, 256)
        group = rng.integers(0, 4, n)
        order, lcp = sort_suffixes(rows, group)
        want = sorted((group[i], bytes(rows[i])) for i in range(n))
        assert [(group[i], bytes(rows[i])) for i in order] == want
        for k in range(1, n):
            (g, x), (h, y) = want[k - 1], want[k]
            common = next((j for j in range(w) if x[j] != y[j]), w) if g == h else 0
            assert lcp[k] == common
