"""Incremental file source for the bronze layer."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .. import fsio
from ..functions.transforms import add_athlete_id, add_ingestion_time
from ..operators.tables import BatchId, append_batch, batch_path, held, read_batches
from ..streaming.runs import RunLog, append_stream, batch_stream, finish
from .evolution import SchemaStore, conform, evolve, observed_schema, parse_lines
from .moving import mover, reachable


class BronzeLoader:
    """Reads each landed file once and appends it to a bronze table.

    ``declared`` fixes the schema.  Without it the schema is inferred once, from the files a
    ``sample`` path names or else from all that landed, kept in ``schema_path`` beside the
    checkpoint and reused by later runs; :meth:`load_evolving` lets it grow instead.

    JSON documents lose nothing to either: fields the schema does not know, values that do not
    fit and broken lines are kept as text in ``_rescued_data``.  With the option ``wholetext``
    (or ``multiLine``) each file is one document, else each line.
    """

    def __init__(self, input_path: str, checkpoint_path: str, format_file: str, *,
                 declared: StructType | None = None, name_filter: str | None = None,
                 max_bytes_per_trigger: int | None = None, archive_path: str | None = None,
                 options: dict[str, str] | None = None, schema_path: str | None = None, sample: str | None = None,
                 spark: SparkSession | None = None):
        self.spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        self.input_path, self.checkpoint_path, self.format_file = input_path, checkpoint_path, format_file
        self.declared, self.sample = declared, sample or input_path
        self.schema_path = schema_path or f"{checkpoint_path.rstrip('/')}-schemas"
        self.options = dict(options or {})
        if name_filter:
            self.options["pathGlobFilter"] = name_filter
        if format_file == "json" and "multiLine" in self.options:
            self.options["wholetext"] = self.options.pop("multiLine")
        self.stream_options = {}
        if max_bytes_per_trigger:
            self.stream_options["maxBytesPerTrigger"] = str(max_bytes_per_trigger)
        if archive_path:
            self.stream_options |= {"cleanSource": "archive", "sourceArchiveDir": archive_path}

    def _schema(self) -> StructType:
        if self.declared is not None:
            return self.declared
        store = SchemaStore(self.spark, self.schema_path)
        known = store.load()
        if not known.fields:
            if self.format_file == "json":
                known = observed_schema(parse_lines(
                    self.spark.read.format("text").options(**self.options).load(self.sample)))
            else:
                known = self.spark.read.format(self.format_file).options(**self.options).load(self.sample).schema
            store.save(known)
        return known

    def _documents(self) -> DataFrame:
        return parse_lines(self.spark.readStream.format("text").options(**self.options, **self.stream_options)
                           .load(self.input_path))

    def read_autoloader(self, schema: Sequence[str] | None = None) -> DataFrame:
        """Stream of new files; ``schema`` is an optional list of select expressions."""
        if self.format_file == "json":
            stream = conform(self._documents(), self._schema())
        else:
            stream = (self.spark.readStream.format(self.format_file).schema(self._schema())
                      .options(**self.options, **self.stream_options).load(self.input_path))
        return stream.selectExpr(*schema) if schema else stream

    def get_ingestion_time_column(self, df: DataFrame) -> DataFrame:
        return add_ingestion_time(df)

    def get_athlete_id_column(self, df: DataFrame) -> DataFrame:
        return add_athlete_id(df)

    def standardize(self, df: DataFrame, owner_documents: bool = False) -> DataFrame:
        """Owner id (unless the documents are the owners themselves) and ingestion stamp."""
        return add_ingestion_time(df if owner_documents else add_athlete_id(df))

    def write_to_bronze(self, df: DataFrame, output_path: str, await_termination: bool = True,
                        fmt: str = "parquet") -> StreamingQuery | RunLog:
        """Append everything new, then stop.

        Waits and returns the progress log, or returns the running query if not asked to wait.
        """
        query = append_stream(df, output_path, self.checkpoint_path, name="bronze_loader", fmt=fmt)
        return finish(query) if await_termination else query

    def load_evolving(self, output_path: str, owner_documents: bool = False) -> RunLog:
        """JSON intake whose schema grows batch by batch (one partition folder per batch).

        Documents are one per line; the option ``wholetext`` takes each file as one document.
        """
        store = SchemaStore(self.spark, self.schema_path)
        written: dict[BatchId, int] = {}

        def intake(batch: DataFrame, batch_id: BatchId) -> None:
            with held(batch, "landed") as rows:
                shaped = evolve(rows, store)
                if not owner_documents and "athlete" in shaped.columns:
                    shaped = add_athlete_id(shaped)
                append_batch(add_ingestion_time(shaped), output_path, batch_id)
                written[batch_id] = rows.count()

        return finish(batch_stream(self._documents(), intake, self.checkpoint_path, name="bronze_evolving"), written)


def load_bronze(input_path: str, output_path: str, format_file: str, checkpoint_path: str, *,
                owner_folder: str = "/athlete/", **options) -> RunLog:
    """One bronze job: everything new below ``input_path``, stamped, appended to ``output_path``.

    Documents get the id of the athlete they belong to, unless they are the athletes
    themselves, which land below ``owner_folder``.
    """
    loader = BronzeLoader(input_path, checkpoint_path, format_file, **options)
    rows = loader.standardize(loader.read_autoloader(), owner_documents=owner_folder in f"{input_path}/")
    return loader.write_to_bronze(rows, output_path)


ARCHIVED = "query string, path string, moved boolean"


def archive_landing(spark: SparkSession, landing: str, archive: str, checkpoint: str) -> int:
    """Move the landing files that a stream has read and committed into a (dated) folder.

    Which ones those are is in the stream's own checkpoint; a file that landed since stays and
    is read by the next run.  The list stays a table: tasks rename the files of their share (no
    content travels), and what they did is a batch of the manifest beside the checkpoint.  Files
    of earlier manifests are left out, so a run looks only at what was read since, and a file
    that lands again under an old name is not taken for a read one.  A run that died is
    repeated: files it had moved already count as moved.  Returns how many moved.

    Tasks reach the file system through Arrow.  Where that cannot open the landing (a store
    only Hadoop knows), the driver renames one file after the other instead.
    """
    commits = [name for name in (p.rsplit("/", 1)[1] for p in fsio.children(spark, f"{checkpoint}/commits"))
               if name.isdigit()]
    if not commits:
        return 0
    query, last = json.loads(fsio.read_text(spark, f"{checkpoint}/metadata"))["id"], max(map(int, commits))
    manifest, root = f"{checkpoint.rstrip('/')}-archived", fsio.qualified(spark, landing)
    known = read_batches(spark, manifest, StructType.fromDDL(ARCHIVED)).filter(F.col("query") == query)
    entries = spark.read.schema("path string, batchId long").json(f"{checkpoint}/sources/*/*")
    read = (entries.filter(F.col("path").isNotNull() & (F.col("batchId") <= last)).select("path").distinct()
            .join(known.select("path"), "path", "left_anti"))
    name = f"{query}-{last}-{hashlib.md5(archive.encode()).hexdigest()[:8]}"
    if fsio.is_committed(spark, batch_path(manifest, name)):  # nothing new was read since
        return 0
    if reachable(root):
        done = read.mapInPandas(mover(root, fsio.qualified(spark, archive)), "path string, moved boolean")
    else:
        done = spark.createDataFrame(
            [(row.path, _rename(spark, row.path, root, archive)) for row in read.toLocalIterator()], "path string, moved boolean")
    append_batch(done.select(F.lit(query).alias("query"), "path", "moved"), manifest, name)
    return spark.read.parquet(batch_path(manifest, name)).filter("moved").count()


def _rename(spark: SparkSession, uri: str, root: str, archive: str) -> bool:
    path = fsio.decoded(spark, uri)
    there = path.startswith(f"{root}/") and fsio.exists(spark, path)
    if there:
        fsio.rename(spark, path, f"{archive}/{path[len(root) + 1:]}")
    return there
