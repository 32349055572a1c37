import math
import random

import numpy as np
import pytest

from mixdetect.llm import langid

LANGS = {"en": "the of and to in is that for it was with as his on be at by".split(),
         "de": "der die und in den von zu das mit sich des auf für ist im dem nicht".split(),
         "fr": "de la le et les des en un du une que est pour qui dans a par".split()}
PAGES = "page_id long, url string, html string, ll string, host string, row string, d0 string"


def text(lang, n, rng):
    return " ".join(rng.choice(LANGS[lang]) for _ in range(n))


@pytest.fixture
def model(spark):
    rng = random.Random(1)
    rows = [(text(lang, 40, rng), lang) for lang in LANGS for _ in range(20)] + [("???", None), (None, "en")]
    return langid.fit_text(spark.createDataFrame(rows, "text string, lang string"))


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], PAGES).repartition(3)


def test_text_model_counts(model):
    assert model.languages == ("de", "en", "fr")
    assert np.allclose(np.exp(model.logp.astype(float)).sum(axis=0), 1, atol=1e-3)
    rng = random.Random(2)
    for k, lang in enumerate(model.languages):
        assert np.argmax(langid.text_evidence(langid.clean(text(lang, 30, rng)), model, 50.0)) == k
    assert langid.text_evidence(b"", model, 50.0).tolist() == [0, 0, 0]


def rows_of(rng):
    rows = [(k, f"http://www.h{k % 5}.example.de/x", f"<html lang='de-DE'><script>the of and</script><p>{text('de', 50, rng)}") for k in range(40)]
    rows += [(100 + k, f"https://en.site{k % 3}.com/", f'<HTML class=a LANG="EN"><p>{text("en", 50, rng)}</p>') for k in range(40)]
    rows += [(200 + k, "http://fr.wide.org/a", f"<html><p>{text('fr', 50, rng)}") for k in range(40)]
    return rows + [(300, "http://www.h1.example.de/short", "<html><p>x</p>"), (301, "http://fr.wide.org/b", ""), (302, "http://fr.wide.org/c", None),
                   (303, None, "<html lang=en>"), (304, "not a url", "..."), (None, None, None), (305, "http://other.example.de/", "<p>qq</p>"),
                   (306, "http://x.new.com/", f"<html lang=de>{text('fr', 400, rng)}"), (5, rows[5][1], rows[5][2])]


def test_evidence_decides(pages, model):
    rng = random.Random(3)
    rows = rows_of(rng)
    out = langid.fuse(langid.rows_of_pages(pages(rows)), model).collect()
    assert len(out) == len(rows)
    got = {r.id: r for r in out}
    assert all(got[k].lang == "de" for k in range(40)) and all(got[100 + k].lang == "en" for k in range(40))
    assert got[300].lang == "de" and got[305].lang == "de"  # by its host, by its domain and suffix
    assert got[301].lang == got[302].lang == "fr"
    assert got[303].lang == "en"  # by what it declares
    assert got[306].lang == "fr" and got[306].declared == "de"  # a long text outweighs a wrong declaration
    for r in out:
        assert sum(r[f"p_{x}"] for x in model.languages) == pytest.approx(1) and r.confidence == pytest.approx(r[f"p_{r.lang}"])


def test_posterior_by_hand(pages, model, monkeypatch):
    rng = random.Random(4)
    rows = rows_of(rng)[::3]
    ev = langid.Evidence()
    frame = langid.rows_of_pages(pages(rows))
    out = {str(r.id): r for r in langid.fuse(frame, model, ev).collect()}
    parsed = frame.collect()
    ll = [langid.text_evidence(langid.clean(langid.visible(r.body)), model, ev.text_cap) for r in parsed]
    q = [np.exp(x) / np.exp(x).sum() for x in ll]
    total = sum(q) + 1.0
    share = total / total.sum()

    def table(key):
        out = {}
        for r, x in zip(parsed, q):
            out[key(r)] = out.get(key(r), 0) + x
        return out

    hosts, domains = table(lambda r: (r.domain, r.host)), table(lambda r: r.domain)
    said, ends = table(lambda r: r.declared), table(lambda r: r.suffix)
    for r, x, own in zip(parsed, ll, q):
        d, h, e, s = domains[r.domain], hosts[r.domain, r.host], said[r.declared], ends[r.suffix]
        m, b = ev.host_prior, ev.table_prior
        domain = (d - own + m * share) / (d.sum() - 1 + m)
        host = (h - own + m * np.maximum(domain, 1e-9)) / (h.sum() - 1 + m)
        z = x + np.log(np.maximum(host, 1e-9)) + sum(np.log((t + b * t.sum() / total.sum()) / (total + b)) for t in (e, s))
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert [out[str(r.id)][f"p_{name}"] for name in model.languages] == pytest.approx(p.tolist(), abs=1e-9)
    assert math.isfinite(sum(r.confidence for r in out.values()))
    monkeypatch.setattr("mixdetect.llm.common.BROADCAST_ROWS", 0)  # salted joins
    again = {str(r.id): r for r in langid.fuse(frame, model, ev).collect()}
    assert all(again[k].confidence == pytest.approx(out[k].confidence) for k in out)


def test_documents_and_empty(spark, frame, pages, model):
    rng = random.Random(5)
    docs = frame([(k, text("de", 30, rng), "src") for k in range(10)] + [(50, None, "src"), (51, "", None)])
    got = {r.id: r.lang for r in langid.fuse(langid.rows_of_texts(docs), model).collect()}
    assert len(got) == 12 and got[50] == "de" and all(got[k] == "de" for k in range(10))
    assert langid.fuse(langid.rows_of_pages(pages([])), model).count() == 0
    nothing = langid.fit_text(spark.createDataFrame([("x", None)], "text string, lang string"))
    assert nothing.languages == ()
    assert [(r.id, r.lang, r.confidence) for r in langid.fuse(langid.rows_of_pages(pages([(1, "http://a.b", "x")])), nothing).collect()] == [(1, None, None)]


def test_more_languages_than_the_limit(spark, pages):
    rng = random.Random(6)
    rows = [(text(lang, 40, rng), lang) for lang in LANGS for _ in range(9)] + [(f"zq{k} xw{k} " * 9, f"tag{k}") for k in range(250)]
    model = langid.fit_text(spark.createDataFrame(rows, "text string, lang string"), max_languages=4)
    assert model.languages == ("de", "en", "fr", langid.OTHER)
    got = {r.id: r.lang for r in langid.fuse(langid.rows_of_pages(pages([(1, None, text("de", 40, rng)), (2, None, "zq7 xw7 " * 20)])), model).collect()}
    assert got == {1: "de", 2: langid.OTHER}


def test_text_without_a_trigram_has_no_text_language(pages, model):
    got = {r.id: r.text_lang for r in langid.fuse(langid.rows_of_pages(pages([(1, None, ""), (2, None, None), (3, None, "der die das und")])), model).collect()}
    assert got[1] is None and got[2] is None and got[3] == "de"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit_text(docs.where("doc_id % 2 = 0"))
    test = docs.where("doc_id % 2 = 1")
    got = {r.id: r.lang for r in langid.fuse(langid.rows_of_texts(test), model).collect()}
    truth = {r.doc_id: r.lang for r in test.collect()}
    assert np.mean([got[k] == truth[k] for k in truth]) > 0.95
