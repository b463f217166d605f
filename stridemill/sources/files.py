"""Batch scans under declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..schemas import CONTROL


def read_table(spark: SparkSession, name: str, catalog: str | None = None, database: str | None = None) -> DataFrame:
    """Current snapshot of a catalog table, optionally after choosing catalog and database."""
    use(spark, catalog, database)
    return spark.read.table(name)


def use(spark: SparkSession, catalog: str | None = None, database: str | None = None) -> None:
    if catalog:
        spark.catalog.setCurrentCatalog(catalog)
    if database:
        spark.catalog.setCurrentDatabase(database)


def read_documents(spark: SparkSession, path: str, schema: StructType, **options: str) -> DataFrame:
    """One JSON document per line.  Fields outside the schema are ignored, absent ones are NULL."""
    return spark.read.options(**options).schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Comma-separated text with a header line, ``\\`` as escape and ``"`` as quote."""
    return spark.read.schema(schema).option("header", True).option("escape", "\\").option("quote", '"').csv(path)


def read_control(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, CONTROL)
