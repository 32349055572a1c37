import random

import numpy as np
import xxhash

from mixdetect.llm import simhash
from mixdetect.llm.graph import components


def fingerprint(text):
    words = (text or "").encode().lower().split()
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes) and hashes)


def groups(ids, fps, radius=3):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    out = []
    for i in range(len(fps)):
        members = [ids[j] for j in range(len(fps)) if label[j] == label[i] and ids[j] is not None]
        out.append(min(members, default=None))
    return out


def test_against_brute_force(frame, prose, clashing):
    texts = [prose(40) for _ in range(60)]
    texts += [t + " end" for t in texts[:10]] + texts[:5] + ["", None, " \t\n", "Aa", "aA", "a b", "É É É", "x " * 3000]
    rows = [(k if k % 9 else None, t) for k, t in enumerate(texts)]
    out = simhash.near_duplicates(clashing(frame(rows))).collect()
    fps = [fingerprint(t) for _, t in rows]
    want = sorted(map(str, zip([r[0] for r in rows], [f"{f:016x}" for f in fps], groups([r[0] for r in rows], fps))))
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in out) == want


def planted(seed, n):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n)]
    out = list(base)
    for b in base[: n // 4]:
        x = b
        for _ in range(rng.randint(1, 5)):  # chains, so that components are longer than one link
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << bit
            out.append(x)
    dense = rng.getrandbits(64)
    out += [dense ^ rng.getrandbits(8) for _ in range(120)]
    return sorted(set(out))


def test_links_connect_what_brute_force_connects(spark, monkeypatch):
    for limit in (20_000, 10):  # 10: hot shards are split
        monkeypatch.setattr(simhash, "SHARD_ROWS", limit)
        monkeypatch.setattr(simhash, "LEAF", 4)
        fps = planted(limit, 250)
        signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
        df = spark.createDataFrame([(f,) for f in signed], "fp long")
        found = simhash.links(df).collect()
        for r in found:
            assert (r.a ^ r.b & 0xFFFFFFFFFFFFFFFF if r.a >= 0 <= r.b else (r.a ^ r.b) & 0xFFFFFFFFFFFFFFFF).bit_count() > 0
        roots = {r.node: r.root for r in components(simhash.links(df), "a", "b").collect()}
        got = [roots.get(f, f) for f in signed]
        assert got == groups(signed, fps)


def test_keep_one(frame, prose, clashing):
    t = [prose(50) for _ in range(6)]
    rows = [(5, t[0]), (3, t[0]), (3, t[0]), (9, t[1]), (None, t[1]), (None, t[2]), (None, t[3]), (4, t[4]), (4, t[5]), (2, None), (8, "")]
    docs = clashing(frame(rows))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(3, t[0]), (9, t[1]), (None, t[2]), (None, t[3]), (4, t[4]), (4, t[5]), (2, None)], key=str)
    assert simhash.keep_one(frame([])).count() == 0 and simhash.near_duplicates(frame([])).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, k) for k in range(200, 400)] + [(7, 7), (500, 501), (501, 500)]
    df = spark.createDataFrame(edges, "a long, b long")
    roots = {r.node: r.root for r in components(df, "a", "b").collect()}
    assert all(roots[k] == 0 for k in range(61)) and all(roots[k] == 200 for k in [1000, *range(200, 400)]) and roots[501] == 500
