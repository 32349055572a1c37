"""File sources: positional CSV (label first) and libsvm.

Both return ``(DataFrame, MixedSpec)`` in the canonical layout
``row_id, label, c0.., x0..``.  Codes and labels stay as they were read
(doubles), so that a fit's validation sees a fractional code instead of its
whole part.  Rows are numbered by an id column if one is named; otherwise the
id is a hash of the row's content, which does not depend on input splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import MixedSpec


def _canonical(df: DataFrame, label: str, cat_src: list[str], cont_src: list[str],
               id_col: str | None = None) -> tuple[DataFrame, MixedSpec]:
    cats = [f"c{i}" for i in range(len(cat_src))]
    conts = [f"x{i}" for i in range(len(cont_src))]
    given = [F.col(id_col).cast("long").alias("row_id")] if id_col else []
    out = df.select(*given, F.col(label).cast("double").alias("label"),
                    *[F.col(s).cast("double").alias(c) for s, c in zip([*cat_src, *cont_src], [*cats, *conts])])
    if not id_col:
        content = F.xxhash64("label", *cats, *conts)
        # equal rows are told apart by an occurrence number; which of them has which makes no difference
        nth = F.row_number().over(Window.partitionBy("__content").orderBy("__content"))
        out = (out.withColumn("__content", content).withColumn("row_id", F.xxhash64(F.col("__content"), nth))
               .select("row_id", "label", *cats, *conts))
    return out, MixedSpec(cat_cols=tuple(cats), cont_cols=tuple(conts))


def read_positional_csv(spark: SparkSession, path: str, first_continuous: int,
                        n_features: int | None = None, header: bool = True,
                        id_col: str | None = None) -> tuple[DataFrame, MixedSpec]:
    """CSV whose first column is ``label`` and whose feature columns are
    categorical up to ``first_continuous`` and continuous after it.

    With ``n_features`` given the schema is explicit (no inference pass over
    the data) and a header that names or orders its columns in another way is
    an error; otherwise Spark infers it, like the original loader.  ``id_col``
    names a column of row ids among an inferred file's columns.
    """
    reader = spark.read.option("header", header)
    if n_features is not None:
        fields = [T.StructField("label", T.DoubleType())]
        fields += [T.StructField(str(i), T.DoubleType()) for i in range(n_features)]
        # the header must agree with the schema, column by column
        reader = reader.schema(T.StructType(fields)).option("enforceSchema", False)
    else:
        reader = reader.option("inferSchema", True)
    df = reader.csv(path)
    label, *features = [c for c in df.columns if c != id_col]
    return _canonical(df, label, features[:first_continuous], features[first_continuous:], id_col)


def read_libsvm(spark: SparkSession, path: str, n_features: int, first_continuous: int) -> tuple[DataFrame, MixedSpec]:
    """libsvm rows ``label idx:value ...`` (1-based indices in the file)."""
    from pyspark.ml.functions import vector_to_array

    raw = (spark.read.format("libsvm").option("numFeatures", n_features).load(path)
           .select("label", vector_to_array("features").alias("f")))
    cols = [F.col("f").getItem(i).alias(f"f{i}") for i in range(n_features)]
    wide = raw.select("label", *cols)
    names = [f"f{i}" for i in range(n_features)]
    return _canonical(wide, "label", names[:first_continuous], names[first_continuous:])


def write_libsvm(df: DataFrame, spec: MixedSpec, path: str) -> None:
    """Write a canonical frame as libsvm (categorical codes first)."""
    from pyspark.ml.feature import VectorAssembler

    cols = list(spec.cat_cols) + list(spec.cont_cols)
    va = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="error")
    (va.transform(df.select(F.col(spec.label).cast("double").alias("label"),
                            *[F.col(c).cast("double").alias(c) for c in cols]))
     .select("label", "features").write.mode("overwrite").format("libsvm").save(path))
