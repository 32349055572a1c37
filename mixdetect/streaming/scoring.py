"""Scoring on Structured Streaming frames.

A fitted model is a constant, so scoring is a stateless projection: the
same ``transform`` plan runs per micro-batch, with no state store and no
watermark needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.detector import DetectorModel
from ..plans.session import ensure_checkpoint_dir


def score_stream(model: DetectorModel, stream: DataFrame, only_anomalies: bool = False) -> DataFrame:
    out = model.transform(stream)
    return out.where("is_anomaly") if only_anomalies else out


def _location(stream: DataFrame, checkpoint_location: str | None, name: str) -> str:
    """Where a query keeps its progress.  A restarted application only finds it in a folder it names itself
    (the session's checkpoint folder is another one for each application), so only local test sessions may leave it out."""
    if checkpoint_location:
        return checkpoint_location.rstrip("/")
    if not stream.sparkSession.sparkContext.master.startswith("local"):
        raise ValueError("name a checkpoint_location in shared storage, so that a restart can resume")
    return f"{ensure_checkpoint_dir(stream.sparkSession).rstrip('/')}/stream-{name}"


def start_scoring_query(model: DetectorModel, stream: DataFrame, sink: str, name: str,
                        path: str | None = None, trigger_available_now: bool = True,
                        only_anomalies: bool = False, checkpoint_location: str | None = None) -> StreamingQuery:
    """Append scored rows to ``sink`` ("memory", "parquet", ...).

    A query restarted with the same ``checkpoint_location`` resumes where it stopped.
    """
    w = (score_stream(model, stream, only_anomalies).writeStream.outputMode("append").format(sink)
         .queryName(name).option("checkpointLocation", _location(stream, checkpoint_location, name)))
    if path is not None:
        w = w.option("path", path)
    if trigger_available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def score_stream_to_parquet(model: DetectorModel, stream: DataFrame, path: str, checkpoint_location: str,
                            columns: list | None = None) -> DataFrame:
    """Run the scoring stream over what there is (``availableNow``) into the Parquet table at ``path`` and return it.

    Nothing passes through the driver: micro-batches are written by the
    executors.  Called again with the same two folders, it scores only new input.
    """
    out = score_stream(model, stream)
    if columns is not None:
        out = out.select(*columns)
    q = (out.writeStream.outputMode("append").format("parquet").option("path", path)
         .option("checkpointLocation", checkpoint_location).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return stream.sparkSession.read.schema(out.schema).parquet(path)


def start_anomaly_sink(model: DetectorModel, stream: DataFrame, path: str, name: str,
                       trigger_available_now: bool = True, checkpoint_location: str | None = None) -> StreamingQuery:
    """Write only the flagged rows of each micro-batch to ``path/run=<query>/batch_id=<id>``.

    Each batch is scored once and cached, so the ``is_anomaly`` filter runs
    above the cache instead of being pushed into the scoring projection (which
    would evaluate the score twice).  A batch writes its own directory in
    overwrite mode, so a retried batch replaces its output instead of adding
    to it; the directory also carries a hash of the checkpoint location, so a
    query with another one, whose batches count from 0 again, overwrites nothing.
    """
    import zlib

    from pyspark import StorageLevel

    location = _location(stream, checkpoint_location, name)
    target = f"{path.rstrip('/')}/run={zlib.crc32(location.encode()):08x}"

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        scored = model.transform(batch).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            scored.where("is_anomaly").write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
        finally:
            scored.unpersist()

    w = stream.writeStream.foreachBatch(write_batch).queryName(name).option("checkpointLocation", location)
    if trigger_available_now:
        w = w.trigger(availableNow=True)
    return w.start()
