import random

import numpy as np
import pytest

from mixdetect.llm import cotrain

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture
def corpus(spark, clashing):
    """Texts whose words show the class and sources that show it too; few are labelled."""

    def make(n=600, labelled=60, seed=0):
        rng = random.Random(seed)
        good, bad, both = ([f"{c}{k}" for k in range(60)] for c in "gbx")
        rows, truth = [], {}
        for k in range(n):
            y = int(rng.random() < 0.6)
            source = f"s{rng.randrange(3) + 3 * y}" if rng.random() < 0.8 else f"s{rng.randrange(6)}"
            words = [rng.choice(both if rng.random() < 0.7 else good if y else bad) for _ in range(rng.randint(5, 60))]
            rows.append((k, " ".join(words), "en", source, len(words)))
            truth[k] = y
        labels = [(k, truth[k], 0) for k in range(labelled)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        return clashing(docs), spark.createDataFrame(labels, LABELS), truth

    return make


def auc(score, y):
    rank = np.argsort(np.argsort(score))
    return (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_learns_and_views_teach_each_other(corpus):
    docs, labels, truth = corpus()
    p = cotrain.CoTraining(exchange=40, calibration=4)
    out = cotrain.score(docs, labels, params=p).toPandas()
    assert len(out) == len(truth) and out.labelled.sum() == 60
    test = out[~out.labelled]
    y = test.doc_id.map(truth).to_numpy()
    assert auc(test.score.to_numpy(), y) > 0.95 and ((test.score >= 0.5) == test.kept).all()
    alone = cotrain.score(docs, labels, params=cotrain.CoTraining(rounds=0, calibration=4)).toPandas()
    alone = alone[~alone.labelled]
    assert auc(test.text_score.to_numpy(), test.doc_id.map(truth).to_numpy()) >= auc(
        alone.text_score.to_numpy(), alone.doc_id.map(truth).to_numpy()) - 0.01
    again = cotrain.score(docs, labels, params=p).toPandas()
    assert np.allclose(out.sort_values("doc_id").score, again.sort_values("doc_id").score)


def test_copies_and_a_large_cell_leave_room_for_others(spark, monkeypatch):
    rng = random.Random(3)

    def text(y):
        return " ".join(f"{'gb'[1 - y]}{rng.randrange(40)}" for _ in range(20))

    rows = [(k, text(k % 2), "en", f"{k % 2}s{k % 6}", 100) for k in range(160)]
    rows += [(1000 + k, " ".join(f"g{j}" for j in range(40)), "en", "1s1", 100) for k in range(300)]  # copies
    rows += [(2000 + k, text(1), "en", "1s3", 100) for k in range(300)]  # a large cell
    rows += [(3000 + k, text(k % 2), "en", f"{k % 2}s{k % 6}", 100) for k in range(180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    fitted, fit = [], cotrain.fit
    monkeypatch.setattr(cotrain, "fit", lambda x, y, w, p: fitted.append(([r.tobytes() for r in x], list(y), list(w))) or fit(x, y, w, p))
    p = cotrain.CoTraining(exchange=20, rounds=3, confident=0.55)
    cotrain.score(docs, spark.createDataFrame([(k, k % 2, 0) for k in range(160)], LABELS), params=p).collect()
    sizes = [[sum(w == 0.5 for w in call[2]) for call in fitted[view::2]] for view in (0, 1)]
    assert sizes == [[0, 40, 80, 120]] * 2
    text_rows, y, w = fitted[-2]
    handed = [x for x, weight in zip(text_rows, w) if weight == 0.5]
    assert len(set(handed)) == len(handed)
    cells, y, w = fitted[-1]
    good = [x for x, label, weight in zip(cells, y, w) if weight == 0.5 and label]
    # 20 a round over three cells: six or seven of each
    assert len(set(good)) == 3 and all(18 <= good.count(x) <= 21 for x in set(good))


def test_odd_rows(spark, frame, prose):
    rows = [(k, f"{'good' if k % 2 else 'bad!!'} {prose(10)}", f"s{k % 2}") for k in range(60)]
    rows += [(100, None, None), (101, "", "s1"), (None, "good good", "s1"), (7, "good again", "s1"), (102, "x " * 200_000, "s0")]
    labels = [(k, k % 2, None) for k in range(40)] + [(3, 0, 0), (5, None, 0), (None, 1, 0), (50, 7, 0), (9, 1, 0), (9999, 1, 1)]
    out = cotrain.score(frame(rows), spark.createDataFrame(labels, LABELS)).toPandas()
    assert len(out) == len(rows) and out.score.between(0, 1).all()
    assert not out[out.doc_id == 3].labelled.any() and out[out.doc_id == 9].labelled.all() and not out[out.doc_id == 50].labelled.any()


def test_few_labels_and_empty(spark, frame):
    none = spark.createDataFrame([], LABELS)
    rows = ["a b", "c d", None]
    assert {r.score for r in cotrain.score(frame(rows), none).collect()} == {0.5}
    assert {r.score for r in cotrain.score(frame(rows), spark.createDataFrame([(0, 1, 0), (1, 1, 0)], LABELS)).collect()} == {1.0}
    assert len(cotrain.score(frame(rows), spark.createDataFrame([(0, 1, 0), (1, 0, 0)], LABELS)).collect()) == 3
    assert cotrain.score(frame([]), none).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = cotrain.score(docs, labels.where("doc_id % 2 = 0")).toPandas()
    test = labels.where("doc_id % 2 = 1").toPandas().merge(out, on="doc_id")
    assert auc(test.score.to_numpy(), test.quality.to_numpy()) > 0.9
    assert (test.kept == (test.quality == 1)).mean() > 0.85


def test_linear_parts():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 50, 10)) + 50 * (k % 2) * (rng.random() < 0.9) for k in range(200)]
    rows[7] = np.empty(0, dtype=int)
    rows = [r.astype(int) for r in rows]
    y = np.array([k % 2 for k in range(200)], dtype=float)
    model = cotrain.fit(rows, y, np.ones(200), cotrain.CoTraining())
    z = model.logits(rows)
    assert ((z > 0) == (y > 0)).mean() > 0.85 and z[7] == model.bias
    one = [sum(model.weights[j] for j in r) / max(1, len(r)) ** 0.5 + model.bias for r in rows]
    assert np.allclose(z, one)
    a, c = cotrain.calibrate(z, y)
    assert a >= 0 and abs((1 / (1 + np.exp(-(a * z + c)))).mean() - y.mean()) < 0.05
