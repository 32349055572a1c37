import random
import re

import pytest
from pyspark.sql import functions as F

from mixdetect.llm import decontam

ITEM = "item_id long, text string, n_words string, covered string"
QUESTION = ("Yesterday morning the farmer Maria Lopez sold 12 baskets of apples for 30 dollars each and then Maria Lopez drove 45 km "
            "to the market where 12 people waited for the apples")


@pytest.fixture
def bench(spark):
    def make(texts):
        return spark.createDataFrame([(*((t[0], t[1]) if isinstance(t, tuple) else (k, t)), "x", "y") for k, t in enumerate(texts)], ITEM)

    return make


def found(df):
    return {r.doc_id: (r.contaminated, r.n_items, r.first_item) for r in df.collect()}


def words(text):
    """Token-wise version of the canonical words: (kind, value)."""
    out, raw = [], re.findall(r"[^\x20\x09-\x0D]+", text or "")
    number = r"[0-9]+(?:[.,:/][0-9]+)*"
    unit = "(?:" + "|".join(sorted(decontam.UNITS, key=len, reverse=True)) + ")"
    for k, w in enumerate(raw):
        core = "".join(c for c in w if c.isalpha() or c.isnumeric())
        strip = re.sub(r"^[^\w]+|[^\w]+$", "", w.replace("_", "-"))
        if k and raw[k - 1][-1] not in ".!?:" and strip.isalpha() and strip[0].isupper() and (strip in w):
            out.append(("p", strip.lower()))
        elif re.fullmatch(number, strip):
            out.append(("n", strip))
        elif re.fullmatch(number + unit, strip, re.I):
            out.append(("q", strip.lower()))
        elif re.fullmatch(unit, strip, re.I) and out and out[-1][0] == "n":
            out.append(("u", strip.lower()))
        else:
            out.append(("w", core.lower()))
    return out


def test_canonical_words(spark):
    texts = [QUESTION, None, "", "  one   Two\n\nThree.  Four (Five), 'Six' SEVEN! Eight: Nine", "5km 12.5 kg, 7 apples 3/4 1,000.50 $5 9% 4 KM.",
             "### -- word-word don't | x", "Ünal sah Özil. Étienne", "a 1st B2 3D", "12 Km 13 m 14 x"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    out = decontam.with_canonical(df, "t", "c").select("k", decontam._split(F.col("c")).alias("w")).collect()
    for r in out:
        got = [(w[1], w[2:-1]) if w.startswith(decontam.OPEN) else ("w", w) for w in r.w]
        assert got == words(texts[r.k]), texts[r.k]


def test_reparameterised_questions(frame, bench, prose, clashing):
    filler = prose(60)
    same = QUESTION.replace("Maria Lopez", "Peter Smith").replace("12", "7").replace("30", "99").replace("45 km", "8 miles")
    inconsistent = QUESTION.replace("Maria Lopez", "Peter Smith", 1).replace("12", "7", 1).replace("then Maria", "then Anna")
    rows = [filler, f"{filler}. {QUESTION} {filler}", f"{filler} {same.lower().replace('peter smith', 'Peter Smith')} {filler}",
            " ".join(QUESTION.split()[:12]), " ".join(QUESTION.split()[:9]), None, "", same.upper(), f"x {QUESTION.upper()}",
            (77, QUESTION), (77, QUESTION), (None, QUESTION), "word " * 30_000 + QUESTION]
    got = found(decontam.contamination(clashing(frame(rows)), bench([prose(20), QUESTION, (9, QUESTION)])))
    assert len(got) == 12
    clean = (False, 0, None)
    assert got[0] == got[3] == got[4] == got[5] == got[6] == clean
    assert got[1] == got[2] == got[77] == got[None] == got[12] == (True, 2, 1)
    assert got[7] == clean  # all capitals: every word is a name, and slots alone identify nothing
    docs = clashing(frame(rows))
    left = decontam.drop_contaminated(docs, bench([QUESTION]))
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["0", "3", "4", "5", "6", "7", "8"]) and left.columns == docs.columns
    pieces = found(decontam.contamination(frame([inconsistent]), bench([QUESTION]), min_words=30))
    whole = found(decontam.contamination(frame([same]), bench([QUESTION]), min_words=30))
    assert not pieces[0][0] and whole[0][0]


def test_short_items_and_empty_tables(frame, bench, prose):
    rows = ["see the quick brown fox jump over", "quick brown fox", "the quick red fox", prose(30)]
    got = found(decontam.contamination(frame(rows), bench(["Quick brown fox!", "", None, "x " * 3])))
    assert [got[k][0] for k in range(4)] == [True, True, False, False]
    assert not any(r[0] for r in found(decontam.contamination(frame(rows), bench([]))).values())
    assert decontam.contamination(frame([]), bench([QUESTION])).count() == 0
    assert decontam.drop_contaminated(frame([]), bench([])).count() == 0


def test_slot_heavy_items_by_their_exact_words(frame, bench, prose):
    items = ["Compute the sum 12 + 35 + 47 + 58 + 61 + 73 + 84 + 96 + 105 + 116 + 127 .",
             "What Is The Boiling Point Of Pure Water At Sea Level When Measured In Degrees Celsius And Kelvin",
             "PARIS LONDON BERLIN", "| --- | --- | --- | --- | --- | --- | --- | --- |"]
    other = items[0].replace("35", "36").replace("61", "62").replace("84", "85").replace("116", "117")
    rows = [f"{prose(20)} {items[0]} {prose(20)}", f"{prose(20)} {items[1].lower()}, {prose(20)}", items[1].upper() + "?",
            f"({items[2].title()}) {prose(9)}", other, items[0].replace("+", "-"), items[3], prose(40)]
    got = found(decontam.contamination(frame(rows), bench(items)))
    assert [got[k][2] for k in range(len(rows))] == [0, 1, 1, 2, None, None, None, None]


def test_wide_tables_take_the_same_way(frame, bench, prose, monkeypatch):
    rng = random.Random(4)
    items = [prose(rng.randint(10, 40)) for _ in range(12)]
    rows = [f"{prose(rng.randint(0, 30))} {rng.choice(items) if k % 3 else ''} {prose(rng.randint(0, 30))}" for k in range(60)]
    one = found(decontam.contamination(frame(rows), bench(items)))
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(decontam, "BROADCAST_KEYS", 0)
    two = found(decontam.contamination(frame(rows), bench(items)))
    assert one == two and sum(r[0] for r in one.values()) == sum(k % 3 > 0 for k in range(60))


def test_native(spark, frame, bench):
    plan = decontam.contamination(frame([QUESTION]), bench([QUESTION]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


SHORT = "Maria has 12 apples and gives away 5 of them today."


def test_short_items_behind_other_words_and_with_another_name(frame, bench, prose):
    rows = [f"Yes and {SHORT}", "Peter has 9 apples and gives away 4 of them today.", SHORT, f"{prose(30)} {SHORT} {prose(30)}",
            "Maria has 12 apples and keeps every one of these for tomorrow.", "has 12 apples and gives away 5", prose(40)]
    got = found(decontam.contamination(frame(rows), bench([SHORT])))
    assert [got[k][0] for k in range(len(rows))] == [True, True, True, True, False, False, False]


def test_sql_on_planted_items(frame, bench, prose):
    import duckdb

    from mixdetect.llm.oracles import ORACLES

    items = [QUESTION, SHORT, "Compute the sum 12 + 35 + 47 + 58 + 61 + 73 + 84 + 96 + 105 + 116 + 127 .", "PARIS LONDON BERLIN",
             "What Is The Boiling Point Of Pure Water At Sea Level", "quick brown fox"]
    rows = [t for item in items for t in (item, f"{prose(12)} {item} {prose(12)}", f"and {item.lower()}", item.upper(), item.replace("12", "7"),
                                          item.replace("Maria", "Anna"), " ".join(item.split()[1:]))] + [None, "", prose(30), "+ - + -"]
    docs, items = frame(rows), bench(items)
    got = sorted(tuple(r) for r in decontam.contamination(docs, items).collect())
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("benchmark", items.toPandas())
    want = con.sql(ORACLES["op6_template_decontamination"]).fetchall()
    assert got == sorted(want) and sum(r[1] for r in got) > 25
