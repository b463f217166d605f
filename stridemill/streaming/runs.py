"""Running a stream until its source is drained, and keeping a log of what it did."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from .. import fsio
from ..operators.tables import append_rows
from ..schemas import RUN_LOG

WRITTEN = "written"
LISTENER_WAIT = 60  # seconds for the last events of a stopped query


class RunLog(list):
    """One entry per micro-batch: query, batchId, inputRows, outputRows, timestamp."""

    @property
    def input_rows(self) -> int:
        return sum(entry["inputRows"] for entry in self)

    @property
    def output_rows(self) -> int:
        return sum(entry["outputRows"] for entry in self)

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(e[f] for f in RUN_LOG.names) for e in self], RUN_LOG)

    def append_to(self, spark: SparkSession, table: str) -> None:
        append_rows(self.to_df(spark), table)


class _Recorder(StreamingQueryListener):
    """Progress of every batch of the runs of this module, until :func:`finish` takes it.

    Spark itself remembers only the latest batches of a query.
    """

    def __init__(self):
        self.names: set[str] = set()
        self.batches: dict[str, list[dict]] = {}
        self.ended: set[str] = set()
        self.changed = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if progress.name not in self.names:
            return
        seen = progress.observedMetrics.get(WRITTEN)
        with self.changed:
            self.batches.setdefault(str(progress.runId), []).append({
                "query": progress.name, "batchId": progress.batchId, "inputRows": progress.numInputRows,
                "outputRows": seen["rows"] if seen is not None else progress.sink.numOutputRows,
                "timestamp": progress.timestamp})

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.ended.add(str(event.runId))
            self.changed.notify_all()

    def take(self, run: str) -> list[dict]:
        with self.changed:
            if not self.changed.wait_for(lambda: run in self.ended, LISTENER_WAIT):
                raise TimeoutError(f"the last events of run {run} did not arrive")
            self.ended.discard(run)
            return self.batches.pop(run, [])


_recorders: dict[str, _Recorder] = {}


def _recorder(spark: SparkSession) -> _Recorder:
    app = spark.sparkContext.applicationId
    if app not in _recorders:
        _recorders[app] = _Recorder()
        spark.streams.addListener(_recorders[app])
    return _recorders[app]


def append_stream(df: DataFrame, output: str, checkpoint: str, name: str, fmt: str = "parquet") -> StreamingQuery:
    """Append rows to files, exactly once, until everything available is processed."""
    _recorder(df.sparkSession).names.add(name)
    counted = df.observe(WRITTEN, F.count(F.lit(1)).alias("rows"))
    return (counted.writeStream.format(fmt).outputMode("append").queryName(name)
            .option("checkpointLocation", checkpoint).option("mergeSchema", "true")
            .trigger(availableNow=True).start(output))


def batch_stream(df: DataFrame, each: Callable[[DataFrame, str], None], checkpoint: str, name: str) -> StreamingQuery:
    """Hand every micro-batch to ``each``; it may see a batch twice after a restart.

    A batch is named by the query's id and its number.  The id lives in the checkpoint: it
    outlasts restarts, and a new checkpoint or another stream has another one.
    """
    spark = df.sparkSession
    _recorder(spark).names.add(name)

    def named(batch: DataFrame, number: int) -> None:
        query = json.loads(fsio.read_text(spark, f"{checkpoint}/metadata"))["id"]
        each(batch, f"{query}-{number}")

    return (df.writeStream.outputMode("append").queryName(name).foreachBatch(named)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def finish(query: StreamingQuery, written: Mapping[str, int] | None = None) -> RunLog:
    """Wait for a draining query and log every one of its batches.

    A file sink's rows are counted on their way; a ``foreachBatch`` callback counts its own
    in ``written``, by the batch's name.
    """
    recorder = _recorder(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate())
    query.awaitTermination()
    log, counts = RunLog(), written or {}
    for entry in recorder.take(str(query.runId)):
        batch = f"{query.id}-{entry['batchId']}"
        if entry["inputRows"] or batch in counts:
            log.append({**entry, "outputRows": counts.get(batch, entry["outputRows"])})
    return log
