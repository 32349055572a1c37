"""Interval coalescing against whole-text encoding, a walk over the ends and all pairs of tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixdetect.llm import align, pieces
from mixdetect.llm.queries import QUERIES

AWKWARD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "▁", "a▁b", "hello<|endoftext|> world</s>", "tabs\t \n end", "don't \x1c stop\x1c ",
           "ﬁ ①　x y é \U0001f600\U0001f600 中文", "x" * 3000, "aaaa " * 50, "\x00 z", "qzx7Qpw0vKtt9" * 30, " " * 2000 + "x", "line\n\n  \n two"]


@pytest.fixture(scope="module")
def pair():
    return align.tokenizer_pair(*(pieces.read_bounded(pieces.tokenizer_path(n)) for n in (align.TOKENIZER, pieces.MODEL)))


def brute_document(pair, text):
    """(tokens of A, of B, groups) of a text, or None."""
    if not text:
        return None
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(pair.a_bytes[i] for i in a) != raw or b"".join(pair.b_bytes[i] for i in b) != raw:
        return None
    sides = []
    for ids, entries in ((a, pair.a_bytes), (b, pair.b_bytes)):
        end, ends = 0, []
        for i in ids:
            end += len(entries[i])
            ends.append(end)
        sides.append(ends)
    cuts = sorted(set(sides[0]) & set(sides[1]))
    groups, start = [], 0
    for cut in cuts:
        groups.append(tuple([i for i, e in zip(ids, ends) if start < e <= cut] for ids, ends in zip((a, b), sides)))
        start = cut
    return a, b, groups


def brute(pair, texts):
    docs = [brute_document(pair, t) for t in texts]
    links = [Counter() if d is None else sum((Counter((x, y) for x in g[0] for y in g[1]) for g in d[2]), Counter()) for d in docs]
    held = Counter(p for c in links for p in c)
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for d, c in zip(docs, links):
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in d[2])
        out.append((len(d[0]), len(d[1]), len(d[2]), sum(c.values()), sum(n for p, n in c.items() if held[p] == most[p[0]]),
                    sum(n * held[p] for p, n in c.items()), hashlib.sha256(written.encode()).hexdigest()))
    return out


def rows(df):
    return {r.doc_id: tuple(r)[1:] for r in df.collect()}


def test_byte_alphabet_is_the_vocabulary_s(pair):
    assert sorted(align.byte_alphabet().values()) == list(range(256))
    single = {t for t in pair.a.get_vocab() if len(t) == 1}
    assert single == set(align.byte_alphabet())


@pytest.mark.parametrize("frequent", [align.FREQUENT, 5, 0])
def test_awkward_texts(frame, pair, frequent):
    assert rows(align.link_digests(frame(AWKWARD), frequent=frequent)) == dict(enumerate(brute(pair, AWKWARD)))


def test_random_texts_small_tables(frame, pair, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("  abcé\nxyzQ7.,'") for _ in range(rng.randint(0, 50))) for _ in range(150)]
    texts += texts[:20]  # copies are documents of their own
    want = dict(enumerate(brute(pair, texts)))
    assert rows(align.link_digests(frame(texts))) == want
    monkeypatch.setattr(align, "TABLE_CHUNKS", 4)
    monkeypatch.setattr(align, "ALIGNED_AT_ONCE", 10)
    table, got = align.AlignedTable(pair, 4), []
    for text in texts:  # the table is full again and again
        numbers, groups, *_ = table.documents([text])
        got.append((*numbers[0].tolist(), hashlib.sha256(groups[0].encode()).hexdigest() if groups[0] else ""))
    assert got == [(*w[:4], w[6]) for w in (want[i] for i in range(len(texts)))]


def test_groups_break_where_a_start_reaches_the_ends():
    starts, ends = np.array([0, 2, 4, 0, 3, 4]), np.array([2, 4, 6, 3, 4, 6])
    order, group = align.coalesce(starts, ends)
    assert group.tolist() == [0, 0, 0, 0, 1, 1] and sorted(order[:4].tolist()) == [0, 1, 3, 4]


def test_written_groups_and_pairs(frame, pair):
    text = "internationalisation of zyzzyva"
    r = align.alignments(frame([text])).first()
    a, b, groups = brute_document(pair, text)
    assert r.groups == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    assert dict(zip(r.pairs, r.times)) == {x * pair.n_b + y: n for (x, y), n in
                                           sum((Counter((x, y) for x in g[0] for y in g[1]) for g in groups), Counter()).items()}


def test_one_group_of_very_many_tokens(frame, pair):
    text = "a" * 400_000  # the ends of both sides meet seldom: links are counted by distinct ids, never listed
    d = brute_document(pair, text[:4000])
    r = align.link_digests(frame([text])).first()
    assert r.n_a == len(pair.a.encode(" " + text).ids) and r.n_b == len(pair.b.encode(text))
    assert r.n_links >= r.n_a and r.n_groups >= 1 and d is not None


def test_empty_table_and_extra_columns(frame, clashing, pair):
    docs = frame(["one two", "two one"])
    assert align.link_digests(docs.limit(0)).count() == 0
    wide = clashing(docs).withColumns({c: F.lit("x") for c in ("doc", "pairs", "times", "pair", "n_docs", "best", "total", "row", "groups", "a_id")})
    assert rows(align.link_digests(wide)) == dict(enumerate(brute(pair, ["one two", "two one"])))


def test_query_over_the_table(spark, pair):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = brute(pair, [d.text for d in docs])
    assert rows(QUERIES["op13_token_alignment"](spark, "/root/testdata/sf0.001")) == {d.doc_id: w for d, w in zip(docs, want)}
