"""Language identification by Bayesian evidence fusion.

log P(language | page) adds up, per language,

* the log-likelihood of the text under byte-trigram models,
* the log-probability of the declared markup language given the language,
* the log-probability of the address suffix given the language, and
* the log-prior of the host, smoothed by its domain, that by all pages.

Trigram models are counted over all labelled documents, per partition and then
per bin.  The other tables are sums of the text-only posteriors, grouped by
declared language, suffix, host and domain; a page's own share is taken out of
the prior it is judged by.  Each is one aggregate with map-side sums, and the
join back is broadcast or salted by its counted size, so a host with a third
of all pages is no hot key.

Defined results: a page without text, declaration or address falls back on
what it has, at last on the overall prior; null values are evidence of their
own kind ("none declared"), not errors; repeated rows count each; an empty
table gives an empty result; without any labelled document there is no
language to choose, and every page's language is null; a page whose text has
no trigram has no ``text_lang``; extra columns are ignored.  Languages beyond
the ``max_languages`` with most documents form one class, ``OTHER``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_key, stored

BINS_LOG2 = 15
MAX_LANGUAGES = 200
#: Class of the documents in all other languages.
OTHER = "other"
#: Trigrams hashed at once.
BLOCK = 4_000_000

_INVISIBLE = re.compile(r"<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
_DECLARED = r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})"


@dataclass(frozen=True)
class Evidence:
    text_cap: float = 50.0  # trigrams at which the text's evidence saturates
    host_prior: float = 5.0  # pseudo-pages of the domain in a host's prior, and of all pages in a domain's
    table_prior: float = 1.0  # pseudo-pages in the tables of declared languages and suffixes


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    logp: np.ndarray  # bins x languages


def trigram_bins(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, dtype=np.int64)
    code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    return (code * np.uint32(2_654_435_761) >> np.uint32(32 - BINS_LOG2)).astype(np.int64)


def clean(text: str | None) -> bytes:
    return b" " + b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()) + b" "


def visible(html: str | None) -> str:
    return _INVISIBLE.sub(" ", html or "")


def fit_text(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_languages: int = MAX_LANGUAGES) -> TextModel:
    """Trigram models of the languages in ``lang_col``, from all documents."""
    sizes = docs.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n"))
    names = [r["lang"] for r in sizes.orderBy(F.desc("n"), "lang").limit(max_languages + 1).collect()]
    if not names:
        return TextModel((), np.zeros((1 << BINS_LOG2, 0), dtype=np.float32))
    lang = F.col(lang_col).cast("string")
    if len(names) > max_languages:
        names = [*[n for n in names[:max_languages - 1] if n != OTHER], OTHER]
        lang = F.when(lang.isin(names), lang).otherwise(F.lit(OTHER))
    names = tuple(sorted(names))
    labelled = docs.where(F.col(lang_col).isNotNull()).select(lang.alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                raw = clean(text.as_py())
                total = sums.setdefault(lang, np.zeros(1 << BINS_LOG2, dtype=np.int64))
                for at in range(0, max(1, len(raw) - 2), BLOCK):
                    total += np.bincount(trigram_bins(raw[at:at + BLOCK + 2]), minlength=len(total))
        for lang, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(total[used])],
                                             ["lang", "bin", "n"])

    counts = labelled.mapInArrow(run, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    counts = stored(counts, "langid-trigrams")
    at = {name: k for k, name in enumerate(names)}
    table = np.full((1 << BINS_LOG2, len(names)), 0.5)
    found = counts.toArrow()  # at most bins x max_languages rows
    table[found.column("bin").to_numpy(), [at[x] for x in found.column("lang").to_pylist()]] += found.column("n").to_numpy()
    return TextModel(names, np.log(table / table.sum(axis=0)).astype(np.float32))


def text_evidence(raw: bytes, model: TextModel, cap: float) -> np.ndarray:
    """Log-likelihood per language, relative to the best; saturates at ``cap`` trigrams' worth."""
    total, n = np.zeros(len(model.languages)), 0
    for at in range(0, max(1, len(raw) - 2), BLOCK):
        bins = trigram_bins(raw[at:at + BLOCK + 2])
        total += model.logp[bins].sum(axis=0, dtype=np.float64)
        n += len(bins)
    total *= cap / (cap + n)
    return total - total.max()


def rows_of_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, domain, suffix, declared, body, markup) of web pages."""
    host = F.regexp_extract(F.lower(F.coalesce(F.col(url_col), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)
    named = pages.select(F.col(id_col).alias("id"), F.nullif(host, F.lit("")).alias("host"),
                         F.nullif(F.lower(F.regexp_extract(F.coalesce(F.col(html_col), F.lit("")), _DECLARED, 1)), F.lit("")).alias("declared"),
                         F.col(html_col).alias("body"), F.lit(True).alias("markup"))
    return named.select("id", "host", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("domain"),
                        F.regexp_extract("host", r"([^.]+)$", 1).alias("suffix"), "declared", "body", "markup")


def rows_of_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The same of plain documents: the source stands for the host; nothing is declared."""
    none = F.lit(None).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("host"), F.lit("").alias("domain"),
                       none.alias("suffix"), none.alias("declared"), F.col(text_col).alias("body"), F.lit(False).alias("markup"))


def fuse(rows: DataFrame, model: TextModel, evidence: Evidence = Evidence()) -> DataFrame:
    """id, host, declared, text_lang, lang, confidence (posterior of lang), and p_<language> for each language."""
    k = range(len(model.languages))
    if not model.languages:
        none = F.lit(None).cast("string")
        return rows.select("id", "host", "declared", none.alias("text_lang"), none.alias("lang"), F.lit(None).cast("double").alias("confidence"))
    shared = rows.sparkSession.sparkContext.broadcast(model)
    cap = evidence.text_cap

    @F.pandas_udf("array<double>")
    def likelihood(body: pd.Series, markup: pd.Series) -> pd.Series:
        return pd.Series([text_evidence(clean(visible(b) if m else b), shared.value, cap) for b, m in zip(body, markup, strict=True)])

    known = stored(rows.select("id", "host", "domain", "suffix", "declared", likelihood("body", "markup").alias("ll")), "langid-text")
    soft = [F.exp(F.col("ll")[i]) for i in k]
    total = sum(soft[1:], soft[0])
    known = known.select("*", *[(soft[i] / total).alias(f"q{i}") for i in k])
    sums = [F.sum(f"q{i}") for i in k]

    overall = known.agg(*[s.alias(f"a{i}") for i, s in enumerate(sums)]).first()
    everywhere = np.array([float(overall[i] or 0) for i in k]) + 1.0
    share = everywhere / everywhere.sum()

    def grouped(key: list[str], prefix: str, counted: DataFrame) -> DataFrame:
        return stored(counted.groupBy(*key).agg(*[s.alias(f"{prefix}{i}") for i, s in enumerate(sums)]), f"langid-{prefix}")

    domains = grouped(["domain"], "d", known)
    hosts = grouped(["domain", "host"], "h", known)
    declared = grouped(["declared"], "e", known)
    suffixes = grouped(["suffix"], "s", known)
    n_declared, n_suffixes = declared.count(), suffixes.count()
    joined = known
    for table, key, n in ((domains, ["domain"], domains.count()), (hosts, ["domain", "host"], hosts.count()),
                          (declared, ["declared"], n_declared), (suffixes, ["suffix"], n_suffixes)):
        joined = join_by_key(joined, table, key, n)

    m, b = evidence.host_prior, evidence.table_prior
    all_of = lambda p: sum((F.col(f"{p}{i}") for i in k), F.lit(0.0))
    scores = []
    for i in k:
        own = F.col(f"q{i}")
        domain = (F.col(f"d{i}") - own + m * float(share[i])) / (all_of("d") - 1 + m)
        host = (F.col(f"h{i}") - own + m * F.greatest(domain, F.lit(1e-9))) / (all_of("h") - 1 + m)
        # P(value | language), with a value's share of all pages as the smoothing
        said = (F.col(f"e{i}") + b * all_of("e") / float(everywhere.sum())) / (float(everywhere[i]) + b)
        ends = (F.col(f"s{i}") + b * all_of("s") / float(everywhere.sum())) / (float(everywhere[i]) + b)
        scores.append((F.col("ll")[i] + F.log(F.greatest(host, F.lit(1e-9))) + F.log(said) + F.log(ends)).alias(f"z{i}"))
    scored = joined.select("id", "host", "declared", "ll", *scores)
    best = F.greatest(*[F.col(f"z{i}") for i in k]) if len(k) > 1 else F.col("z0")
    scored = scored.withColumn("__best", best)
    weight = [F.exp(F.col(f"z{i}") - F.col("__best")) for i in k]
    norm = sum(weight[1:], weight[0])

    def first_of(cols: list, top) :
        out = F.lit(model.languages[-1])
        for i in reversed(k[:-1]):
            out = F.when(cols[i] == top, model.languages[i]).otherwise(out)
        return out

    return scored.select("id", "host", "declared", F.when(F.array_min("ll") < 0, first_of([F.col("ll")[i] for i in k], F.array_max("ll"))).alias("text_lang"),
                         first_of([F.col(f"z{i}") for i in k], F.col("__best")).alias("lang"), (1.0 / norm).alias("confidence"),
                         *[(weight[i] / norm).alias(f"p_{model.languages[i]}") for i in k])
