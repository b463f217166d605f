"""Spark session set-up and the shared working folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

from . import fsio

# Settings every result of this package relies on.  They are all runtime SQL
# settings, so they can also be applied to a session somebody else built.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}

_fallback_dirs: dict[str, str] = {}


def shuffle_settings(shuffle_bytes: float | None, partition_bytes: int = 256 * 1024 ** 2) -> dict[str, str]:
    """Shuffle settings for a cluster job whose largest shuffle moves ``shuffle_bytes``.

    Spark starts with that many partitions of ``partition_bytes`` and joins small neighbours
    afterwards; it never splits an aggregate's partitions, so starting with too few is what
    must not happen.  Without a size the default of two hundred stays.
    """
    if not shuffle_bytes:
        return {}
    parts = str(max(200, -(-int(shuffle_bytes) // partition_bytes)))
    return {"spark.sql.shuffle.partitions": parts,
            "spark.sql.adaptive.coalescePartitions.initialPartitionNum": parts,
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes)}


def build_session(app: str = "stridemill", master: str | None = None, shuffle_bytes: float | None = None,
                  **conf: str) -> SparkSession:
    """Session with the package defaults; ``conf`` entries win over them.

    On a cluster leave ``master`` unset, let ``spark-submit`` size the executors and give
    ``shuffle_bytes``, what the job's largest shuffle moves (see :func:`shuffle_settings`).
    A local session gets one shuffle partition per core, because two hundred tiny
    ones only cost scheduling time there.
    """
    settings = dict(SEMANTICS) | ({} if master else shuffle_settings(shuffle_bytes))
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        cores = master[master.find("[") + 1:-1] if "[" in master else "1"
        settings["spark.sql.shuffle.partitions"] = str(os.cpu_count()) if cores == "*" else cores
        settings["spark.ui.enabled"] = "false"
        settings["spark.ui.showConsoleProgress"] = "false"
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_semantics(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings of :data:`SEMANTICS` on an existing session."""
    for key, value in SEMANTICS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster the absence is an error, since a machine-local path would be lost
    together with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _fallback_dirs:
        _fallback_dirs[app] = tempfile.mkdtemp(prefix="stridemill-")
    return _fallback_dirs[app]


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh, uniquely named folder of this application below :func:`shared_dir`."""
    return f"{_application_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def _application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stridemill/{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Delete the run folders of this application, with the databases that lie in them.

    Results that are read from there lazily end with it: call it when none is in use.
    """
    folder = _application_dir(spark)
    inside = fsio.qualified(spark, folder)
    for database in spark.catalog.listDatabases():
        if fsio.qualified(spark, database.locationUri).startswith(f"{inside}/"):
            spark.sql(f"DROP DATABASE `{database.name}` CASCADE")
    fsio.delete(spark, folder)
