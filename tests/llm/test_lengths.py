import numpy as np
import pytest

from mixdetect.llm import lengths


@pytest.fixture(scope="module")
def enc():
    with open(lengths.TOKENIZER, "rb") as f:
        return lengths.encoder(f.read())


def test_table(frame, prose, clashing, enc):
    texts = [prose(n % 50) for n in range(150)] + [None, "", "", " ", "x\n\n  y", "long " * 4000, "a" * 3000, prose(30), "don't 12,5 été"]
    ns = np.array([len(enc.encode_ordinary(t)) if t else 0 for t in texts])
    table = lengths.length_table(clashing(frame(texts)))
    got = {r.length: r for r in table.collect()}
    assert sorted(got) == sorted(set(ns.tolist()))
    for length, r in got.items():
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == ((ns == length).sum(), (ns >= length).sum(), ns[ns >= length].sum())
        assert (r.truncated_total, r.total_docs, r.total_tokens) == (np.minimum(ns, length).sum(), len(ns), ns.sum())
    limits = [0, 1, 7, 50, 1023, 1024, 10 ** 6]
    cut = {r.context_limit: r for r in lengths.truncated_totals(table, limits).collect()}
    for x in limits:
        assert (cut[x].truncated_total, cut[x].docs_cut) == (np.minimum(ns, x).sum(), (ns > x).sum())
    q = {r.share: r.length for r in lengths.quantiles(table, [0.01, 0.5, 0.9, 1.0]).collect()}
    for share, length in q.items():
        assert length == np.sort(ns)[int(np.ceil(share * len(ns))) - 1]


def test_pieces_change_nothing(enc):
    text = "Ein  Satz,\n\n  noch\tein 12345 Satz 'tis don't été  " * 60
    for size in (1, 5, 17, 200):
        assert "".join(lengths.pieces(text, size)) == text
        assert sum(len(enc.encode_ordinary(p)) for p in lengths.pieces(text, size)) == len(enc.encode_ordinary(text))


def test_empty(frame):
    table = lengths.length_table(frame([]))
    assert table.count() == 0 and lengths.truncated_totals(table, [5]).collect()[0].truncated_total == 0


def test_long_runs_of_white_space_and_letters(enc, monkeypatch):
    for run in (" ", "\n", "\t", " \n", "\u3000"):
        for before, after in (("", ""), ("prose, ", "more"), ("x", " y z"), ("12", "\x1c!")):
            text = before + run * 300 + after
            want = len(enc.encode_ordinary(text))
            monkeypatch.setattr(lengths, "_LONG_RUN", lengths.re.compile(f"[{lengths.SPACE}]{{20,}}"))
            assert lengths.encoded_length(text, enc) == want
            monkeypatch.undo()
    assert lengths.encoded_length("so " + " " * 5_000_000 + "much", enc) == 5_000_000 + 2  # this vocabulary has no longer token of spaces
    assert lengths.encoded_length("\n" * 5_000_000, enc) == 2_500_000
    assert lengths.encoded_length("a" * 5_000_000, enc) == len(enc.encode_ordinary("a" * 5_000_000))


def test_separators_that_only_python_takes_as_white_space(enc):
    text = "!\x1c!\x1d " * 50
    assert sum(len(enc.encode_ordinary(p)) for p in lengths.pieces(text, 3)) == len(enc.encode_ordinary(text))


def test_table_with_megabytes_of_white_space(frame):
    rows = [" " * 1_200_000, "word" + "\n" * 1_200_000 + "word", "short"]
    assert {r.length: r.n_docs for r in lengths.length_table(frame(rows)).collect()} == {1_200_000: 1, 600_003: 1, 1: 1}
