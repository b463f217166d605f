"""Small metadata operations on whatever file system Spark is configured for.

Only names and status records pass through here; file contents never do.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def is_committed(spark: SparkSession, path: str) -> bool:
    """Whether a Spark write to ``path`` ran to its commit."""
    return exists(spark, f"{path}/_SUCCESS")


def delete(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target) and fs.delete(target, True)


def rename(spark: SparkSession, source: str, destination: str) -> None:
    fs, src = _fs(spark, source)
    dst = spark._jvm.org.apache.hadoop.fs.Path(destination)
    parent = dst.getParent()
    if parent is not None:
        fs.mkdirs(parent)
    if not fs.rename(src, dst):
        raise OSError(f"could not move {source} to {destination}")


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, without a trailing slash."""
    fs, target = _fs(spark, path)
    return fs.makeQualified(target).toString().rstrip("/")


def decoded(spark: SparkSession, uri: str) -> str:
    """The path behind an escaped address, as stream logs write it."""
    jvm = spark._jvm
    return qualified(spark, jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri)).toString())


def replace(spark: SparkSession, source: str, destination: str) -> None:
    """Rename over an existing file in one step of the file system."""
    jvm = spark._jvm
    src, dst = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(destination)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        dst.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration())
    context.rename(src, dst, options)


def same_file_system(spark: SparkSession, one: str, other: str) -> bool:
    return _fs(spark, one)[0].getUri().equals(_fs(spark, other)[0].getUri())


def children(spark: SparkSession, path: str) -> list[str]:
    """Full paths directly below ``path``, sorted; empty when it does not exist."""
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return []
    return sorted(status.getPath().toString() for status in fs.listStatus(target))


def data_files(spark: SparkSession, path: str) -> list[str]:
    """Children Spark would read: partition folders count even under a leading underscore."""
    def hidden(name: str) -> bool:
        return name.startswith(".") or (name.startswith("_") and "=" not in name)
    return [p for p in children(spark, path) if not hidden(p.rsplit("/", 1)[1])]


def folders(spark: SparkSession, path: str, depth: int) -> list[str]:
    """Relative names of the partition folders ``depth`` levels below ``path``."""
    if depth == 0:
        return [""]
    below = [p.rsplit("/", 1)[1] for p in data_files(spark, path)]
    return ["/".join(filter(None, [name, rest])) for name in below
            for rest in folders(spark, f"{path}/{name}", depth - 1)]


def read_text(spark: SparkSession, path: str) -> str:
    """Content of one small metadata file (a stored schema)."""
    fs, target = _fs(spark, path)
    stream = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write one small metadata file; it appears under its name only when whole."""
    fs, target = _fs(spark, path)
    partial = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.partial")
    stream = fs.create(partial, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(partial, target):
        raise OSError(f"could not publish {path}")
