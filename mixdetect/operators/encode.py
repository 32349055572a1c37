"""Profiling, validation and one-hot layout of the categorical columns.

One aggregate job answers every shape question of a fit at once: row count,
per-column code range (-> slot widths), invalid-code counts, null counts and
the population variance of every continuous column (-> GMM variance start).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import add_all
from ..spec import MixedSpec, SlotLayout


@dataclass(frozen=True)
class Profile:
    n: int
    widths: tuple[int, ...]
    cat_min: tuple[int | None, ...]
    bad_codes: tuple[int, ...]
    cat_nulls: tuple[int, ...]
    cont_var: tuple[float | None, ...]
    cont_bad: tuple[int, ...]
    cont_inf: tuple[int, ...] = ()


#: Codes at or above it (or NaN, or infinite) are no codes.
MAX_CODE = "9.0E15D"


def profile_frame(df: DataFrame, spec: MixedSpec) -> DataFrame:
    """The single-row profile aggregate (also registered as a query)."""
    return df.selectExpr(*_profile_sql(spec))


def _profile_sql(spec: MixedSpec) -> list[str]:
    from ..functions import sql as S

    aggs = ["count(1) AS n_rows"]
    for c in spec.cat_cols:
        v, dv = S.ident(c), f"CAST({S.ident(c)} AS DOUBLE)"
        finite = f"CASE WHEN abs({dv}) < {MAX_CODE} THEN {v} END"
        aggs += [
            f"CAST(min({finite}) AS BIGINT) AS {S.ident(c + '_min')}",
            f"CAST(max({finite}) AS BIGINT) AS {S.ident(c + '_max')}",
            f"coalesce(CAST(max({finite}) AS BIGINT), -1) + 1 AS {S.ident(c + '_width')}",
            f"CAST(sum(CASE WHEN {v} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS {S.ident(c + '_nulls')}",
            f"CAST(sum(CASE WHEN NOT ({dv} >= 0 AND {dv} < {MAX_CODE} AND {dv} = rint({dv})) THEN 1 ELSE 0 END) AS BIGINT) "
            f"AS {S.ident(c + '_bad')}",
        ]
    names = spec.cont_cols if not spec.cont_array else [f"{spec.cont_array}_{j}" for j in range(spec.cont_dim)]
    for x, name in zip(S.cont_refs(spec), names):
        aggs += [
            f"var_pop({x}) AS {S.ident(name + '_var')}",
            f"CAST(sum(CASE WHEN {x} IS NULL OR isnan({x}) THEN 1 ELSE 0 END) AS BIGINT) AS {S.ident(name + '_bad')}",
            f"CAST(sum(CASE WHEN abs({x}) = double('infinity') THEN 1 ELSE 0 END) AS BIGINT) AS {S.ident(name + '_inf')}",
        ]
    return aggs


#: Dimensions of an array column from which they are profiled as rows instead of as columns of one aggregate.
WIDE_PROFILE = 256


def wide_profile_frame(df: DataFrame, array: str) -> DataFrame:
    """(dim, var, bad, inf) of an array column: one map-side combined group per dimension."""
    t = df.select(F.posexplode_outer(F.col(array).cast("array<double>")).alias("dim", "x"))
    x = F.col("x")
    return t.groupBy("dim").agg(F.var_pop("x").alias("var"), F.sum((x.isNull() | F.isnan(x)).cast("long")).alias("bad"),
                                F.sum((F.abs(x) == float("inf")).cast("long")).alias("inf"))


def leave_one_out_profiles(df: DataFrame, spec: MixedSpec, part: str, parts: int) -> list[Profile]:
    """For each part, the profile of all rows outside it: one aggregate by part, whose rows are put together."""
    if spec.cont_array and spec.cont_dim > WIDE_PROFILE:
        return [profile(df.where(F.col(part) != f), spec) for f in range(parts)]
    from ..functions import sql as S

    means = [f"avg({x}) AS {S.ident(f'__mean{j}')}" for j, x in enumerate(S.cont_refs(spec))]
    rows = {r[part]: r for r in df.groupBy(part).agg(*[F.expr(e) for e in [*_profile_sql(spec), *means]]).collect()}  # one row a part
    return [_merged(spec, [r for p, r in rows.items() if p != f]) for f in range(parts)]


def _merged(spec: MixedSpec, rows: list) -> Profile:
    n = sum(r["n_rows"] for r in rows)
    names = spec.cont_cols if not spec.cont_array else [f"{spec.cont_array}_{j}" for j in range(spec.cont_dim)]
    variances = []
    for j, x in enumerate(names):
        known = [(r["n_rows"] - r[f"{x}_bad"], r[f"__mean{j}"], r[f"{x}_var"]) for r in rows if r[f"__mean{j}"] is not None]
        total = sum(k for k, _, _ in known)
        mean = sum(k * m for k, m, _ in known) / total if total else 0.0
        variances.append(sum(k * (v + (m - mean) ** 2) for k, m, v in known) / total if total else None)

    def added(suffix: str, cols) -> tuple[int, ...]:
        return tuple(sum(int(r[f"{c}{suffix}"] or 0) for r in rows) for c in cols)

    return Profile(n, tuple(max((int(r[f"{c}_width"]) for r in rows), default=0) for c in spec.cat_cols),
                   tuple(min((r[f"{c}_min"] for r in rows if r[f"{c}_min"] is not None), default=None) for c in spec.cat_cols),
                   added("_bad", spec.cat_cols), added("_nulls", spec.cat_cols), tuple(variances), added("_bad", names), added("_inf", names))


def profile(df: DataFrame, spec: MixedSpec, wide: int = WIDE_PROFILE) -> Profile:
    if spec.cont_array and spec.cont_dim > wide:
        rest = profile(df, MixedSpec(row_id=spec.row_id, label=spec.label, cat_cols=spec.cat_cols))
        dims = {r["dim"]: r for r in wide_profile_frame(df, spec.cont_array).collect()}  # <= dimensions + 1 rows
        missing = dims[None]["bad"] if None in dims else 0  # rows without an array
        got = [dims.get(j) for j in range(spec.cont_dim)]
        return Profile(rest.n, rest.widths, rest.cat_min, rest.bad_codes, rest.cat_nulls, tuple(r and r["var"] for r in got),
                       tuple(missing + (r["bad"] if r else rest.n) for r in got), tuple(int(r["inf"] or 0) if r else 0 for r in got))
    row = profile_frame(df, spec).first()
    n = int(row["n_rows"])
    cats = spec.cat_cols
    conts = list(spec.cont_cols) if not spec.cont_array else [f"{spec.cont_array}_{j}" for j in range(spec.cont_dim)]
    return Profile(
        n=n,
        widths=tuple(int(row[f"{c}_width"]) for c in cats),
        cat_min=tuple(row[f"{c}_min"] for c in cats),
        bad_codes=tuple(int(row[f"{c}_bad"] or 0) for c in cats),
        cat_nulls=tuple(int(row[f"{c}_nulls"] or 0) for c in cats),
        cont_var=tuple(row[f"{x}_var"] for x in conts),
        cont_bad=tuple(int(row[f"{x}_bad"] or 0) for x in conts),
        cont_inf=tuple(int(row[f"{x}_inf"] or 0) for x in conts),
    )


def validate(p: Profile, spec: MixedSpec, n_components: int | None = None) -> None:
    if p.n == 0:
        raise ValueError("the input has 0 rows; a fit needs at least one per component")
    if n_components is not None and p.n < n_components:
        raise ValueError(f"the input has {p.n} rows, too few for {n_components} components; lower gaussian_num or add rows")
    for c, bad, nulls in zip(spec.cat_cols, p.bad_codes, p.cat_nulls):
        if nulls:
            raise ValueError(f"categorical column {c!r} has {nulls} null values")
        if bad:
            raise ValueError(f"categorical column {c!r} has {bad} negative or fractional codes")
    conts = spec.cont_cols if not spec.cont_array else [spec.cont_array] * spec.cont_dim
    for c, bad in zip(conts, p.cont_bad):
        if bad:
            raise ValueError(f"continuous column {c!r} has {bad} null or NaN values")
    for c, infinite in zip(conts, p.cont_inf):
        if infinite:
            raise ValueError(f"continuous column {c!r} has {infinite} infinite values")


def slot_layout(p: Profile, spec: MixedSpec) -> SlotLayout:
    return SlotLayout(tuple(spec.cat_cols), tuple(p.widths))


# ---------------------------------------------------------------------------
# One-hot
# ---------------------------------------------------------------------------

def hot_flags(layout: SlotLayout) -> list[Column]:
    """Wide form: one 0/1 column expression per slot."""
    out = []
    for i, c in enumerate(layout.cat_cols):
        for v in range(layout.widths[i]):
            out.append(F.when(F.col(c) == v, 1).otherwise(0))
    return out


def unseen_count(layout: SlotLayout) -> Column:
    return add_all([F.when((F.col(c) < 0) | (F.col(c) >= w), 1).otherwise(0)
                    for c, w in zip(layout.cat_cols, layout.widths)]) if layout.cat_cols else F.lit(0)


def one_hot_wide(df: DataFrame, layout: SlotLayout, keep: list[str]) -> DataFrame:
    """Rows with an array<int> of hot flags (concatenated blocks)."""
    return df.select(*keep, F.array(*hot_flags(layout)).alias("one_hot"))


def one_hot_long(df: DataFrame, layout: SlotLayout, row_id: str = "row_id") -> DataFrame:
    """(row_id, slot, hot): a generator over the flag array, no shuffle."""
    return (one_hot_wide(df, layout, [row_id])
            .select(row_id, F.posexplode("one_hot").alias("slot", "hot")))
