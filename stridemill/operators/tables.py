"""Batch-partitioned tables and table maintenance on plain columnar files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import fsio
from ..session import run_dir

# A batch is named by the caller's number, or by the query and the number a stream gives it
# (see streaming.runs), so that neither a reset checkpoint nor a second stream repeats a name.
BATCH_COLUMN = "_batch_id"
BatchId = int | str


def batch_path(table: str, batch_id: BatchId) -> str:
    return f"{table}/{BATCH_COLUMN}={batch_id}"


def append_batch(df: DataFrame, table: str, batch_id: BatchId, fmt: str = "parquet") -> bool:
    """Append a batch exactly once; returns False when it was already committed.

    A batch owns one partition folder.  A retry after a crash overwrites the unfinished
    folder; a retry after the commit leaves its files, and so every reader of them, alone.
    """
    spark = df.sparkSession
    folder = batch_path(table, batch_id)
    if fsio.is_committed(spark, folder):
        return False
    df.drop(BATCH_COLUMN).write.format(fmt).mode("overwrite").save(folder)
    return True


def _with_batch(schema: StructType) -> StructType:
    return StructType([*[f for f in schema.fields if f.name != BATCH_COLUMN], StructField(BATCH_COLUMN, StringType())])


def without_rows(spark: SparkSession, schema: StructType) -> DataFrame:
    """A table that the optimizer knows to be empty: joins with it move nothing."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]).filter(F.lit(False))


def read_batches(spark: SparkSession, table: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """The table under a declared schema; columns an old batch lacks are NULL."""
    full = _with_batch(schema)
    if not fsio.data_files(spark, table):
        return without_rows(spark, full)
    return spark.read.format(fmt).schema(full).load(table)


def snapshot(spark: SparkSession, table: str, schema: StructType) -> DataFrame:
    """All rows of a batch-partitioned table, without the batch column."""
    return read_batches(spark, table, schema).select(*schema.names)


def stream_batches(spark: SparkSession, table: str, schema: StructType, fmt: str = "parquet",
                   max_bytes_per_trigger: int | None = None) -> DataFrame:
    """Only the rows added since the reading query's last checkpoint.

    Everything available is one micro-batch unless the caller asks for smaller ones.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    return reader.load(table).select(*schema.names).drop(BATCH_COLUMN)


@contextmanager
def held(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """``df``, computed once into the shared folder for several reads; gone afterwards."""
    spark, path = df.sparkSession, run_dir(df.sparkSession, label)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        fsio.delete(spark, path)


def compact(spark: SparkSession, table: str, schema: StructType, destination: str,
            cluster_by: Sequence[str] = (), catalog_table: str | None = None) -> None:
    """Rewrite many small batch folders as one well-filled copy of the table.

    The copy is a new folder: readers keep the old one until the catalog entry moves.  It
    takes the newest batch's name, and every batch it holds leaves an empty committed folder,
    so that a batch retried afterwards is still known.  For tables without other partitions;
    :mod:`upkeep` packs what the partitioned merges write.
    """
    if any(f"/{BATCH_COLUMN}=" not in p for p in fsio.data_files(spark, table)):
        raise ValueError(f"{table} has partitions besides its batches")
    batches = sorted((p.rsplit(f"{BATCH_COLUMN}=", 1)[1] for p in fsio.data_files(spark, table)), key=_batch_order)
    if not batches:
        return
    packed = read_batches(spark, table, schema).drop(BATCH_COLUMN).hint("rebalance")
    if cluster_by:
        packed = packed.sortWithinPartitions(*cluster_by)
    append_batch(packed, destination, batches[-1])
    for batch in batches[:-1]:
        fsio.write_text(spark, f"{batch_path(destination, batch)}/_SUCCESS", "")
    if catalog_table:
        known = spark.catalog.getTable(catalog_table)
        if known.tableType != "EXTERNAL":
            raise ValueError(f"{catalog_table} owns its files and cannot be pointed elsewhere")
        # moving the location alone would keep the partitions of the old folder
        spark.sql(f"DROP TABLE {catalog_table}")
        create_partitioned(spark, catalog_table, _with_batch(schema), [BATCH_COLUMN], destination,
                           comment=known.description)
        recover_partitions(spark, catalog_table)


def _batch_order(name: str) -> tuple[str, int]:
    query, _, number = name.rpartition("-")
    return query, int(number) if number.isdigit() else -1


def append_rows(df: DataFrame, table: str) -> None:
    """Append to a managed table, creating it on first use."""
    df.write.mode("append").saveAsTable(table)


def replace_snapshot(df: DataFrame, root: str, version: str, table: str | None = None) -> str:
    """Full rebuild with schema replacement.

    Written beside the running snapshot (a folder cannot be overwritten while it is read),
    then published by moving the catalog entry's location, with new columns added before.
    Only a schema that drops or retypes a column needs a new entry, for whose making the
    table is absent for a moment.
    """
    spark = df.sparkSession
    location = f"{root}/{version}"
    df.write.mode("overwrite").parquet(location)
    if not table:
        return location
    if not spark.catalog.tableExists(table):
        register_external(spark, table, location)
        return location
    known = {f.name: f.dataType for f in spark.read.table(table).schema.fields}
    fields = {f.name: f.dataType for f in df.schema.fields}
    if all(fields.get(name) == kind for name, kind in known.items()):
        new = {f"`{n}`": k.simpleString() for n, k in fields.items() if n not in known}
        if new:
            add_columns(spark, table, **new)
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{location}'")
        spark.catalog.refreshTable(table)
    else:
        spark.sql(f"DROP TABLE {table}")  # external: the files stay
        register_external(spark, table, location)
    return location


def replace_managed(df: DataFrame, table: str) -> None:
    df.write.mode("overwrite").saveAsTable(table)


def register_external(spark: SparkSession, table: str, location: str, comment: str | None = None,
                      fmt: str = "parquet") -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} USING {fmt}{_comment(comment)} LOCATION '{location}'")


def _comment(text: str | None) -> str:
    return "" if text is None else " COMMENT '" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def recover_partitions(spark: SparkSession, table: str) -> None:
    spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")


def create_partitioned(spark: SparkSession, table: str, schema: StructType, partitions: Sequence[str],
                       location: str | None = None, properties: dict[str, str] | None = None,
                       comment: str | None = None) -> None:
    """Typed table with partition columns and table properties."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    options = ", ".join(f"'{k}' = '{v}'" for k, v in (properties or {}).items())
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet PARTITIONED BY ({', '.join(partitions)})"
              + _comment(comment) + (f" LOCATION '{location}'" if location else "")
              + (f" TBLPROPERTIES ({options})" if options else ""))


def write_partitioned(df: DataFrame, location: str, partitions: Sequence[str], mode: str = "overwrite") -> None:
    """Partitioned write with well-filled files.

    The rebalance brings a partition's rows together but, unlike a plain repartition, lets
    AQE split one that holds a large share of the data over several tasks.
    """
    df.hint("rebalance", *partitions).write.mode(mode).partitionBy(*partitions).parquet(location)


def create_as_select(spark: SparkSession, table: str, query: DataFrame) -> None:
    query.write.mode("errorifexists").saveAsTable(table)


def export_single_csv(df: DataFrame, destination: str) -> str:
    """One CSV file under an exact name, for small per-owner tables such as load control.

    Only the finished rows meet in one task; whatever computes them stays distributed.  The
    lone part file is written to a side folder and moved into place.
    """
    spark = df.sparkSession
    staging = f"{destination}.staging"
    df.repartition(1).write.mode("overwrite").option("header", True).option("escapeQuotes", False).csv(staging)
    parts = [p for p in fsio.data_files(spark, staging) if p.rsplit("/", 1)[1].startswith("part-")]
    fsio.replace(spark, parts[0], destination)
    fsio.delete(spark, staging)
    return destination


def truncate(spark: SparkSession, *tables: str) -> None:
    for table in tables:
        spark.sql(f"TRUNCATE TABLE {table}")


def drop(spark: SparkSession, *tables: str) -> None:
    for table in tables:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def add_columns(spark: SparkSession, table: str, **columns: str) -> None:
    """Widen a table; each value is a type, optionally followed by a comment clause."""
    listed = ", ".join(f"{name} {kind}" for name, kind in columns.items())
    spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({listed})")


def add_partitions(spark: SparkSession, table: str, folders: Sequence[str], root: str | None = None) -> None:
    """Let the catalog point the named partitions at their folders below ``root`` (by default
    the table's own).  New ones are added together; each one that is known switches at once."""
    known = {r[0] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()} if root else set()

    def where(folder: str) -> str:
        return f" LOCATION '{root}/{folder}'" if root else ""
    new = [f"PARTITION {_spec(spark, f)}{where(f)}" for f in folders if f not in known]
    for at in range(0, len(new), 200):
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {' '.join(new[at:at + 200])}")
    for folder in folders:
        if folder in known:
            spark.sql(f"ALTER TABLE {table} PARTITION {_spec(spark, folder)} SET{where(folder)}")


def drop_partitions(spark: SparkSession, table: str, folders: Sequence[str]) -> None:
    """Take partitions out of the catalog; files of an external table stay."""
    specs = [f"PARTITION {_spec(spark, f)}" for f in folders]
    for at in range(0, len(specs), 200):
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {', '.join(specs[at:at + 200])}")


def partition_values(spark: SparkSession, folder: str) -> tuple[str | None, ...]:
    """The values a partition's name spells, as text."""
    naming = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    values = [naming.unescapePathName(part.split("=", 1)[1]) for part in folder.split("/")]
    return tuple(None if v == "__HIVE_DEFAULT_PARTITION__" else v for v in values)


def _spec(spark: SparkSession, folder: str) -> str:
    columns = [part.split("=", 1)[0] for part in folder.split("/")]
    return "(" + ", ".join(f"`{c}` = {_literal(v)}" for c, v in zip(columns, partition_values(spark, folder))) + ")"


def _literal(value: str | None) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def reset_checkpoints(spark: SparkSession, *paths: str) -> None:
    """Forget stream progress, so the next run starts from the beginning.

    Stored schemas lie beside the checkpoint and stay.  The next run has another query id, so
    its batches are new ones to the tables they are merged into.
    """
    for path in paths:
        fsio.delete(spark, path)
