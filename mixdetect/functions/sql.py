"""Spark SQL expression strings for the generated per-row formulas.

Building a Column tree node by node costs one driver-JVM round trip per
node; the E-step and SGD plans are rebuilt every iteration, so they are
written as SQL expression text and handed to ``selectExpr`` in one call.
Catalyst produces the same plan either way.
"""

from __future__ import annotations

import math
from collections.abc import Sequence


def num(v: float) -> str:
    """A DOUBLE literal (Spark reads a bare 0.5 as DECIMAL)."""
    v = float(v)
    if math.isnan(v):
        return "CAST('NaN' AS DOUBLE)"
    if math.isinf(v):
        return "CAST('Infinity' AS DOUBLE)" if v > 0 else "CAST('-Infinity' AS DOUBLE)"
    return f"({v!r}D)" if v < 0 else f"{v!r}D"


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def add(terms: Sequence[str]) -> str:
    if not terms:
        return "0.0D"
    return "(" + " + ".join(terms) + ")"


def log_sigmoid(m: str) -> str:
    return f"(-(greatest(-{m}, 0.0D) + ln(1.0D + exp(-abs({m})))))"


def sigmoid(m: str) -> str:
    return f"(CASE WHEN {m} >= 0 THEN 1.0D / (1.0D + exp(-abs({m}))) ELSE exp(-abs({m})) / (1.0D + exp(-abs({m}))) END)"


def cont_refs(spec) -> list[str]:
    """SQL references to the continuous values of a MixedSpec."""
    if spec.cont_array:
        return [f"CAST({ident(spec.cont_array)}[{i}] AS DOUBLE)" for i in range(spec.cont_dim)]
    return [f"CAST({ident(c)} AS DOUBLE)" for c in spec.cont_cols]


def aliased(expr: str, name: str) -> str:
    return f"{expr} AS {ident(name)}"


def keep(cols: Sequence[str]) -> list[str]:
    return [ident(c) for c in cols]
