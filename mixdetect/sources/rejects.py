"""File sources that set malformed input aside instead of failing or turning it into nulls.

Each reader returns ``(clean rows, rejects, MixedSpec)``.  Clean rows have the
canonical layout of :mod:`mixdetect.sources.files`.  A reject keeps its line,
its file and all reasons, in the order of the fields.  Both frames are lazy
projections of the same scan: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.encode import MAX_CODE
from ..spec import MixedSpec
from .files import _canonical

CORRUPT = "__corrupt"


def _problem(found: Column, text: str) -> Column:
    return F.when(found, F.lit(text))


def _field_problems(name: str, given: Column, value: Column, is_code: bool) -> list[Column]:
    """What is wrong with one field: at most one of these is not null."""
    out = [_problem(given.isNull(), f"{name}: empty"), _problem(given.isNotNull() & value.isNull(), f"{name}: not a number")]
    if is_code:
        top = F.expr(MAX_CODE)
        return [*out, _problem(~((value >= 0) & (value < top) & (value == F.rint(value))), f"{name}: not a code")]
    return [*out, _problem(F.isnan(value) | (F.abs(value) == float("inf")), f"{name}: not finite")]


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row, however often they are read above.

    Spark would substitute their expressions into every use (a filter, each
    problem, each feature); it does not do so across a generator.
    """
    row = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("__once")
    return df.select("*", row).select(*df.columns, *[F.col("__once").getField(name).alias(name) for name in columns])


def _split(df: DataFrame, line: Column, file: Column, reasons: Column, label: str, cats: list[str], conts: list[str],
           id_col: str | None) -> tuple[DataFrame, DataFrame, MixedSpec]:
    judged = df.withColumns({"__line": line, "__file": file, "__reasons": reasons})
    clean, spec = _canonical(judged.where(F.size("__reasons") == 0), label, cats, conts, id_col)
    rejects = judged.where(F.size("__reasons") > 0).select(F.col("__line").alias("line"), F.col("__reasons").alias("reasons"),
                                                           F.col("__file").alias("file"))
    return clean, rejects, spec


def read_csv_with_rejects(spark: SparkSession, path: str, first_continuous: int, n_features: int, header: bool = True,
                          id_col: str | None = None) -> tuple[DataFrame, DataFrame, MixedSpec]:
    """Positional CSV (label, then ``n_features`` features, categorical up to ``first_continuous``), split into clean rows and rejects.

    ``id_col`` names a leading column of whole-number row ids.  A line is
    rejected for another number of fields, or else for each field that is
    empty, not a number, not finite (label and continuous) or not a code
    (categorical: negative, fractional, NaN, infinite).  Blank lines are
    skipped, as CSV readers do.  An empty file gives two empty frames; a
    header that names other columns is an error.
    """
    names = [*([id_col] if id_col else []), "label", *[str(i) for i in range(n_features)]]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, CORRUPT]])
    # every field is parsed whatever is selected: a line's verdict must not hang on the columns a query reads
    raw = (spark.read.schema(schema).option("header", header).option("enforceSchema", False).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).csv(path))
    # the fields under names of their own: those of the file are numbers
    values = {f"__v{i}": F.expr(f"try_cast(trim(`{c}`) AS DOUBLE)") for i, c in enumerate(names)}
    df = raw.withColumns(values)
    malformed = F.col(CORRUPT).isNotNull()
    problems = [_problem(malformed, "wrong number of fields")]
    first = 1 if id_col else 0
    for i, c in enumerate(names):
        feature = i - first - 1
        is_code = 0 <= feature < first_continuous
        found = _field_problems(c, F.col(f"`{c}`"), F.col(f"__v{i}"), is_code)
        if id_col and i == 0:  # an id of any sign, as long as it is whole
            whole = F.expr(f"try_cast(trim(`{c}`) AS BIGINT)")
            found = [found[0], _problem(F.col(f"`{c}`").isNotNull() & whole.isNull(), f"{c}: not a whole number")]
        problems += [F.when(~malformed, p) for p in found]
    line = F.coalesce(F.col(CORRUPT), F.to_csv(F.struct(*[F.col(f"`{c}`") for c in names])))
    cols = [f"__v{i}" for i in range(first, len(names))]
    # ids beyond 2^53 are no doubles: the id comes from its own text
    if id_col:
        df = df.withColumn("__id", F.expr(f"try_cast(trim(`{id_col}`) AS BIGINT)"))
    return _split(df, line, F.col("_metadata.file_path"), F.array_compact(F.array(*problems)), cols[0], cols[1:1 + first_continuous], cols[1 + first_continuous:],
                  "__id" if id_col else None)


def read_libsvm_with_rejects(spark: SparkSession, path: str, n_features: int, first_continuous: int) -> tuple[DataFrame, DataFrame, MixedSpec]:
    """libsvm lines ``label index:value ...`` (indices from 1), split into clean rows and rejects.

    A line is rejected for a label that is no finite number, a pair that is not
    ``index:value``, an index outside 1..n_features, indices that do not
    ascend, and for values that are not finite or, for categorical features,
    not codes.  Absent indices are zero.  Text after ``#`` is a comment; lines
    with nothing else are skipped.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__path"))
    body = F.translate(F.substring_index("value", "#", 1), "\t\x0b\x0c\r", "    ")
    body = F.trim(F.when(F.contains(body, F.lit("  ")), F.regexp_replace(body, " ++", " ")).otherwise(body))
    df = _once(text, __body=body).where("__body <> ''")
    # after the label; "" for a line of a label alone
    df = _once(df, __rest=F.expr("CASE WHEN instr(__body, ' ') > 0 THEN substring(__body, instr(__body, ' ') + 1) ELSE '' END"))
    pairs = r"__rest = '' OR __rest RLIKE '^[0-9]++:[^: ]++(?: [0-9]++:[^: ]++)*+$'"
    df = _once(df, __label=F.expr("try_cast(substring_index(__body, ' ', 1) AS DOUBLE)"),
               __cells=F.expr(f"CASE WHEN __rest = '' THEN array() WHEN {pairs} THEN split(__rest, '[ :]') END"))
    df = _once(df, __at=F.expr("transform(filter(__cells, (x, k) -> k % 2 = 0), x -> try_cast(x AS BIGINT))"),
               __val=F.expr("transform(filter(__cells, (x, k) -> k % 2 = 1), x -> try_cast(x AS DOUBLE))"))
    df = df.withColumn("__formed", F.expr("__cells IS NOT NULL AND forall(__at, i -> i IS NOT NULL) AND forall(__val, v -> v IS NOT NULL)"))
    code = f"v >= 0 AND v < {MAX_CODE} AND v = rint(v)"
    finite = "NOT isnan(v) AND abs(v) < double('infinity')"

    def unless(condition: str, reason: str) -> Column:
        return F.when(F.col("__formed") & ~F.expr(condition), F.lit(reason))

    label = F.col("__label")
    problems = [_problem(label.isNull(), "label: not a number"), _problem(F.isnan(label) | (F.abs(label) == float("inf")), "label: not finite"),
                _problem(~F.col("__formed"), "pair: not index:value"),
                unless(f"forall(__at, i -> i BETWEEN 1 AND {int(n_features)})", "index: out of range"),
                unless("forall(zip_with(__at, slice(__at, 2, size(__at)), (i, j) -> j IS NULL OR i < j), x -> x)", "index: not ascending"),
                unless(f"forall(zip_with(__at, __val, (i, v) -> i > {int(first_continuous)} OR ({code})), x -> x)", "value: not a code"),
                unless(f"forall(zip_with(__at, __val, (i, v) -> i <= {int(first_continuous)} OR ({finite})), x -> x)", "value: not finite")]
    # only clean lines are looked up, and those have each index once
    names = [f"__v{i}" for i in range(n_features)]
    looked = {f"__v{i}": F.expr(f"coalesce(try_element_at(__val, nullif(CAST(array_position(__at, {i + 1}L) AS INT), 0)), 0.0D)")
              for i in range(n_features)}
    df = _once(df, __why=F.array_compact(F.array(*problems))).withColumns(looked)
    return _split(df, F.col("value"), F.col("__path"), F.col("__why"), "__label", names[:first_continuous], names[first_continuous:], None)
