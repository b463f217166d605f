"""Connected components by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fsio import delete
from .common import SMALL_ROWS, stage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node it reaches.

    Every round takes the least label among a node and its neighbours, aggregated on the map
    side, and then the label of that label, so paths shrink by half or more.  Each round is
    written to the shared folder; the one before it is deleted.  Labels of few nodes are sent
    to every executor, so that such a round shuffles only its least labels.  Nothing but
    counts reaches the driver.  No links give an empty table.
    """
    pairs = links.select(F.col("a").alias("node"), F.col("b").alias("peer"))
    edges = stage(pairs.union(pairs.select("peer", "node")).distinct(), "edges")
    labels = stage(edges.groupBy("node").agg(F.least(F.col("node"), F.min("peer")).alias("root")), "labels")
    few = labels.count() <= SMALL_ROWS

    def sent(frame: DataFrame) -> DataFrame:
        return F.broadcast(frame) if few else frame
    while True:
        near = (edges.join(sent(labels.withColumnRenamed("node", "peer")), "peer")
                .groupBy("node").agg(F.min("root").alias("_near")))
        low = (near.join(sent(labels), "node")
               .select("node", F.col("root").alias("_old"), F.least("root", "_near").alias("_label")))
        jump = labels.select(F.col("node").alias("_label"), F.col("root").alias("_beyond"))
        after = stage(low.join(sent(jump), "_label", "left")
                      .select("node", "_old", F.least("_label", F.coalesce("_beyond", "_label")).alias("root")),
                      "labels")
        changed = after.filter("root != _old").limit(1).count()
        _drop(labels)
        labels = after.select("node", "root")
        if not changed:
            _drop(edges)
            return labels


def _drop(staged: DataFrame) -> None:
    for path in {file.rsplit("/", 1)[0] for file in staged.inputFiles()}:
        delete(staged.sparkSession, path)
