"""Counts of dirty rows that ride on the scoring pass.

A row whose feature is null scores null, a NaN scores NaN, and an unseen code
lights no slot.  ``DataFrame.observe`` counts each of these while the rows are
scored, so no second pass over the data is needed; on a stream the same
metrics arrive with each micro-batch's progress.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import sql as S
from ..spec import MixedSpec, SlotLayout
from .encode import MAX_CODE


def issue_sql(spec: MixedSpec, layout: SlotLayout) -> dict[str, str]:
    """Boolean SQL for each issue a row can have, never null.

    ``null_<c>``: no value; ``nan_<c>`` and ``inf_<c>``: continuous value not
    finite; ``bad_<c>``: a code that is negative, fractional, NaN or infinite;
    ``unseen_<c>``: a proper code beyond the fitted ones.  An array column
    counts once a row, for any of its values (``bad_`` for another length).
    """
    out = {}
    for c, width in zip(layout.cat_cols, layout.widths, strict=True):
        v = f"CAST({S.ident(c)} AS DOUBLE)"
        proper = f"({v} >= 0 AND {v} < {MAX_CODE} AND {v} = rint({v}))"
        out[f"null_{c}"] = f"{v} IS NULL"
        out[f"bad_{c}"] = f"coalesce(NOT {proper}, false)"
        out[f"unseen_{c}"] = f"coalesce({proper} AND {v} >= {int(width)}, false)"
    if spec.cont_array:
        a, name = f"CAST({S.ident(spec.cont_array)} AS ARRAY<DOUBLE>)", spec.cont_array
        out[f"null_{name}"] = f"({a} IS NULL OR exists({a}, x -> x IS NULL))"
        out[f"nan_{name}"] = f"coalesce(exists({a}, x -> coalesce(isnan(x), false)), false)"
        out[f"inf_{name}"] = f"coalesce(exists({a}, x -> coalesce(abs(x) = double('infinity'), false)), false)"
        out[f"bad_{name}"] = f"coalesce(size({a}) <> {int(spec.cont_dim)}, false)"
        return out
    for c in spec.cont_cols:
        x = f"CAST({S.ident(c)} AS DOUBLE)"
        out[f"null_{c}"] = f"{x} IS NULL"
        out[f"nan_{c}"] = f"coalesce(isnan({x}), false)"
        out[f"inf_{c}"] = f"coalesce(abs({x}) = double('infinity'), false)"
    return out


def quality_metrics(spec: MixedSpec, layout: SlotLayout, score: str = "score", flag: str | None = "is_anomaly") -> list[Column]:
    """Aggregates over scored rows: ``n_rows``, one count for each issue, ``n_dirty`` (rows with any issue),
    ``null_scores``, ``nan_scores`` and, with a flag column, ``n_flagged``."""
    issues = issue_sql(spec, layout)
    dirty = " OR ".join(f"({e})" for e in issues.values()) or "false"
    counts = {"n_rows": "true", **issues, "n_dirty": dirty, "null_scores": f"{S.ident(score)} IS NULL",
              "nan_scores": f"coalesce(isnan({S.ident(score)}), false)"}
    if flag:
        counts["n_flagged"] = f"coalesce({S.ident(flag)}, false)"
    return [F.expr(f"count_if({e})").alias(name) for name, e in counts.items()]


def observed(scored: DataFrame, spec: MixedSpec, layout: SlotLayout, to: Observation | str, score: str = "score",
             flag: str | None = "is_anomaly") -> DataFrame:
    """``scored`` with its quality counted by whichever action reads it first (batch: an Observation; stream: a name)."""
    return scored.observe(to, *quality_metrics(spec, layout, score, flag))


def with_issues(df: DataFrame, spec: MixedSpec, layout: SlotLayout, out: str = "issues") -> DataFrame:
    """Adds the names of the row's issues as an array, empty for a clean row."""
    named = [f"CASE WHEN {e} THEN '{name.replace(chr(39), chr(92) + chr(39))}' END" for name, e in issue_sql(spec, layout).items()]
    found = f"filter(array({', '.join(named)}), x -> x IS NOT NULL)" if named else "CAST(array() AS ARRAY<STRING>)"
    return df.withColumn(out, F.expr(found))
