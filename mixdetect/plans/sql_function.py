"""A fitted model as SQL functions: its scoring expression, callable from ``spark.sql``.

The function's body is the same generated formula as ``transform``'s, with
the parameters as literals; Spark inlines it into the calling query, which
stays without Python and inside whole-stage code generation.
"""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

from ..functions import sql as S
from ..operators.gmm import component_logpdf_sql
from ..operators.logistic import h_sql, slot_sign_sql
from .detector import DetectorModel

#: Terms of the inlined formula.  A wider model has no SQL function; its ``transform`` scores it at any size.
FUNCTION_TERMS = 20_000


def _terms(model: DetectorModel) -> int:
    k, J, d = model.logistic.k, model.layout.n_slots, model.spec.d
    return J * k * (d + 1) + (model.gmm.K * d if model.gmm is not None else 0) * 2


def log_p_cont_sql(model: DetectorModel) -> str:
    """log p(x): the largest weighted component density and the sum of the others over it."""
    if model.gmm is None or model.spec.d == 0:
        return "0.0D"
    lps = component_logpdf_sql(model.gmm, S.cont_refs(model.spec), True)
    if len(lps) == 1:
        return lps[0]
    top = f"greatest({', '.join(lps)})"
    return f"({top} + ln({S.add([f'exp({e} - {top})' for e in lps])}))"


def log_p_cat_sql(model: DetectorModel) -> str:
    """log P(y|x): the slots' log-sigmoids.  Repeated subexpressions are computed once by the generated code."""
    if model.layout.n_slots == 0:
        return "0.0D"
    p = model.logistic
    hs = h_sql(p, model.spec)
    slots = []
    for j, sign in enumerate(slot_sign_sql(model.layout)):
        margin = S.add([f"{h} * {S.num(p.W[r, j])}" for r, h in enumerate(hs)])
        slots.append(S.log_sigmoid(f"({sign} * {margin} / {S.num(p.lam)})"))
    return S.add(slots)


def score_sql(model: DetectorModel) -> str:
    """The model's score as SQL text over the columns of its spec."""
    if model.params.on_unseen != "all_zero":
        raise ValueError("a SQL function scores unseen codes as no slot; use transform for on_unseen='error'")
    if _terms(model) > FUNCTION_TERMS:
        raise ValueError(f"the formula has {_terms(model)} terms, more than {FUNCTION_TERMS}; use transform")
    op = "+" if model.params.mode == "joint" else "*"
    return f"({log_p_cat_sql(model)} {op} {log_p_cont_sql(model)})" if op == "*" else f"({log_p_cont_sql(model)} + {log_p_cat_sql(model)})"


def flag_sql(score: str, threshold: float | None, tail: str) -> str:
    """``is_anomaly`` of a score: never for NaN or without a threshold, null for a null score."""
    if threshold is None or math.isnan(threshold):
        return "false"
    return f"({score} {'<=' if tail == 'low' else '<'} {S.num(threshold)} AND NOT isnan({score}))"


def register_score_functions(spark: SparkSession, model: DetectorModel, name: str = "anomaly_score",
                             flag_name: str | None = "is_anomaly_score", proba_name: str | None = "anomaly_probability") -> list[str]:
    """Creates temporary SQL functions of the session and returns their names.

    ``name(features..)`` takes the categorical columns, then the continuous
    ones (or the array), in the order of the spec, and returns the score.
    ``flag_name(score)`` tells whether a score is anomalous, and
    ``proba_name(score)`` its place in the score range; the latter is made only
    once ``fit_range`` has set one.  Registering again replaces them.
    """
    spec = model.spec
    conts = [f"{S.ident(spec.cont_array)} ARRAY<DOUBLE>"] if spec.cont_array else [f"{S.ident(c)} DOUBLE" for c in spec.cont_cols]
    args = ", ".join([f"{S.ident(c)} DOUBLE" for c in spec.cat_cols] + conts)
    made = []

    def create(function: str, arguments: str, returns: str, body: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {S.ident(function)}({arguments}) RETURNS {returns} RETURN {body}")
        made.append(function)

    create(name, args, "DOUBLE", score_sql(model))
    if flag_name:
        create(flag_name, "score DOUBLE", "BOOLEAN", flag_sql("score", model.threshold, model.params.tail))
    lo, hi = model.score_min, model.score_max
    if proba_name and lo is not None and hi is not None and lo != hi:
        create(proba_name, "score DOUBLE", "DOUBLE", f"(score - {S.num(lo)}) / {S.num(float(hi) - float(lo))}")
    return made
