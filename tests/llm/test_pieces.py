"""Distinct-chunk encoding against the library on whole texts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from mixdetect.llm import pieces
from mixdetect.llm.queries import QUERIES

AWKWARD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "  a   b  ", "▁", "a▁b ▁ c", "▁▁x ", "\t\n a\r\n b", "\x00 z\x00",
           "<s> </s> <unk> <0x41>", "ﬁ ①　x y é \U0001f600\U0001f600", "中文 字", " " * 5000, "word " * 3000,
           "x" * 20_000, "\n" * 3000 + " end"]


@pytest.fixture(scope="module")
def sp():
    return pieces.processor(pieces.read_bounded(pieces.tokenizer_path(pieces.MODEL)))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(sp, text):
    ids = sp.encode(text or "")
    return len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids) if ids else "")


def test_awkward_texts_equal_the_library(frame, sp):
    got = pieces.digests(frame(AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(sp, AWKWARD[r.doc_id]), repr(AWKWARD[r.doc_id])[:80]


def test_random_texts_and_a_table_of_three_chunks(frame, sp):
    rng = random.Random(3)
    texts = ["".join(rng.choice("  ▁abé\n.1") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for limit in (3, pieces.TABLE_CHUNKS):
        for r in pieces.digests(frame(texts), table_chunks=limit).collect():
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(sp, texts[r.doc_id]), repr(texts[r.doc_id])


def test_ids_and_decoded_texts(frame, sp, prose):
    texts = [prose(50), None, "", "  two  spaces "]
    for r in pieces.encode(frame(texts)).collect():
        assert r.ids == sp.encode(texts[r.doc_id] or "") and r.n_tokens == len(r.ids)
        assert r.decoded == (texts[r.doc_id] or "")


def test_a_text_of_megabytes(frame, sp):
    text = ("lorem ipsum " * 200_000) + " " * 300_000 + "tail"
    r = pieces.digests(frame([text])).first()
    assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(sp, text)


def test_a_chunk_is_segmented_once(sp):
    class Counting:
        calls = 0

        def encode(self, text, **kw):
            self.calls += 1
            return sp.encode(text, **kw)

    one = Counting()
    table = pieces.ChunkTable(one)
    for _ in range(3):
        table.document("again and again and once")
    assert one.calls == 3


def test_repeats_empty_table_extra_columns_and_string_ids(frame, clashing, sp):
    docs = frame([(1, "same text"), (1, "same text")])
    assert pieces.digests(docs).count() == 2
    assert pieces.digests(docs.limit(0)).count() == 0
    wide = clashing(docs).withColumns({c: F.lit("x") for c in ("n_tokens", "ids", "ids_sha256", "decoded")})
    assert pieces.digests(wide).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {r.doc_id for r in pieces.digests(named).collect()} == {"d1"}


def test_models_whose_pieces_cross_markers_are_refused():
    class Crossing:
        def get_piece_size(self):
            return 1

        def id_to_piece(self, i):
            return "of▁the"

    with pytest.raises(ValueError, match="cross"):
        pieces.check_model(Crossing())


def test_query_over_the_table(spark, sp):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = QUERIES["op11_sentence_pieces"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(sp, docs[r.doc_id])
