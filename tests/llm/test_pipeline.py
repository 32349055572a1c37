import os
import subprocess
import sys

import zstandard

import corpus_pipeline
from mixdetect.llm import compression, mixing

from .test_repeats import brute as cut_brute
from .test_simhash import fingerprint, groups

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = {r.doc_id: r for r in docs.collect()}
    comp = zstandard.ZstdCompressor(level=3)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "source_mixing"]

    kept = stages["quality_rules"](spark, docs, SF)
    want = [i for i, r in given.items() if compression.judge(r.text, compression.Bands(), comp)[-1]]
    assert rows(kept) == sorted((tuple(given[i]) for i in want), key=str) and 0 < len(want) < len(given)

    one = stages["simhash_near_dedup"](spark, kept, SF)
    fps = [fingerprint(given[i].text) for i in want]
    left = [i for i, g in zip(want, groups(want, fps)) if i == g]
    assert rows(one) == sorted((tuple(given[i]) for i in left), key=str) and len(left) < len(want)

    short = stages["suffix_array_dedup"](spark, one, SF)
    texts = {i: given[i].text if b[1] == 0 else b[4].decode("utf-8", "ignore") for i, b in zip(left, cut_brute([given[i].text for i in left]))}
    assert {r.doc_id: (r.text, r.n_chars) for r in short.collect()} == {i: (t, len(t)) for i, t in texts.items()}

    clean = stages["benchmark_decontamination"](spark, short, SF)
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {i for i, t in texts.items() if any(q in " ".join(t.split()) for q in items)}
    gone = set(texts) - {r.doc_id for r in clean.collect()}
    assert leaks and leaks <= gone and len(gone) <= len(leaks) + 3  # parts of an item count from 13 words on

    mixed = stages["source_mixing"](spark, clean, SF)
    assert [s.columns for s in (kept, one, short, clean)] == [docs.columns] * 4
    taken = {r.doc_id: r.copies for r in mixing.mix(clean).collect()}
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
        assert r.text == texts[r.doc_id]
    assert got == {i: n for i, n in taken.items() if n}


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert rows(corpus_pipeline.run(spark, SF)) == rows(docs)


def test_odd_rows_pass_all_stages(spark, frame, clashing, prose):
    long = prose(40)
    given = [(None, None), (None, ""), (1, None), (2, long), (2, long), (3, long), (None, prose(30)), (4, "x " * 40_000), (5, prose(20_000), None)]
    for docs in (clashing(frame(given)), clashing(frame([]))):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            assert docs.columns == columns, name
        left = docs.collect()
        assert all(r.text and r.text.split() for r in left)
        own = set(frame([]).columns)
        assert all(r[c] == "x" for r in left for c in columns if c not in own)


def test_entry_without_the_subpackage(tmp_path):
    """The entry file still serves the other queries where the folders are gone."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = ("import sys, builtins, importlib.abc\n"
            "class Gone(importlib.abc.MetaPathFinder):\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name.split('.')[0] == 'corpus_pipeline' or name.startswith('mixdetect.llm'):\n"
            "            raise ModuleNotFoundError(name, name=name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e\n"
            "q, o = e.queries(), e.oracle_sql()\n"
            "assert q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q and set(o) <= set(q)\n")
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
