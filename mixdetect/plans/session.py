"""Session-level helpers (no module here starts a SparkSession)."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows from which a fit's input is dealt anew, and rows that a task gets then.
SPREAD_ROWS, ROWS_PER_TASK = 200_000, 1_000_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Reliable checkpoint directory: the cluster's ``spark.checkpoint.dir``.

    Only a local-mode session without that setting (tests) gets a private
    temporary directory; on a cluster a missing setting is an error, since a
    machine-local folder would not survive the loss of an executor.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 -- Spark Connect: the server owns the checkpoint setting
        conf = spark.conf.get("spark.checkpoint.dir", None)
        if conf:
            return conf
        raise RuntimeError("set spark.checkpoint.dir to a shared (distributed) folder") from None
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir() or conf
    if sc.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="mixdetect-ckpt-")
        sc.setCheckpointDir(path)
        return sc.getCheckpointDir() or path
    raise RuntimeError("set spark.checkpoint.dir to a shared (distributed) folder")


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate results in the shared checkpoint folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def delete_checkpoint(df: DataFrame | None) -> None:
    """Delete the files of a checkpointed frame (if any) that is not read any more."""
    if df is None:
        return
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        delete_folder(df.sparkSession, file.get())


def recommended_conf(cpus: int) -> dict[str, str]:
    """Session settings the detector's plans are tuned for.

    The scoring and E-step stages fuse many generated expressions into one
    whole-stage method; HotSpot does not JIT methods above 8000 bytes of
    bytecode by default, which leaves such a stage interpreted (about 6x
    slower, measured).  ``-XX:-DontCompileHugeMethods`` lifts that limit; on
    JVMs where it cannot be set, ``spark.sql.codegen.hugeMethodLimit=8000``
    (Spark's own advice for HotSpot) splits the stage instead.
    """
    jit = "-XX:-DontCompileHugeMethods"
    return {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.extraJavaOptions": jit,
        "spark.executor.extraJavaOptions": jit,
        # the fit runs two job chains from two threads, each in its own pool
        "spark.scheduler.mode": "FAIR",
        "spark.sql.shuffle.partitions": str(max(8, 2 * cpus)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }


def local_parallelism(spark: SparkSession) -> int | None:
    """Default parallelism of a classic session (None under Spark Connect)."""
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001
        return None


def spread_rows(df: DataFrame) -> DataFrame:
    """``df`` in even partitions, as many as the cores or a multiple, whatever files and row groups it is read from.

    A file of one row group is read by one task, and all passes of a fit over
    the cached rows would stay in that task.  Few rows stay as they are.  The
    rows are dealt by their places, so that neither nulls nor copies gather in one
    partition; counting them reads no column of a parquet scan.
    """
    n = df.count()
    if n < SPREAD_ROWS:
        return df
    cores = local_parallelism(df.sparkSession) or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(cores * math.ceil(n / (cores * ROWS_PER_TASK)), F.monotonically_increasing_id())
