"""Where the rows of a key lie: a narrow table beside a partitioned one.

A merge that replaces rows by key has to find a key's earlier row, in whichever partition
that is.  The places name the partitions, so only those are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import fsio
from .filters import in_folders, matched, unmatched, value_range
from .tables import BATCH_COLUMN, BatchId, append_batch, batch_path, read_batches

INITIAL = "initial"


class KeyPlaces:
    """Keys and the partition values their rows have or once had, in batch folders below ``folder``.

    Entries are only added: a place too many costs a partition read in vain, so a repeated or
    abandoned batch does no harm.  A table that has rows already is entered once, in full.
    """

    def __init__(self, folder: str, keys: Sequence[str], slots: Sequence[str]):
        self.folder, self.keys, self.slots = folder, list(keys), list(slots)

    def read(self, rows: DataFrame) -> DataFrame:
        schema = StructType([rows.schema[c] for c in [*self.keys, *self.slots]])
        return read_batches(rows.sparkSession, self.folder, schema).drop(BATCH_COLUMN)

    def within(self, source: DataFrame, table: DataFrame, batch_id: BatchId) -> Column:
        """Filter that keeps the partitions of ``table`` where rows of ``source``'s keys lie or will.

        The new places are entered before it is used, and so before the rows they speak of are
        written.  Of the places, file statistics skip what lies outside the source's range of
        the last key; what comes to the driver are the partitions found.
        """
        spark, columns = source.sparkSession, [*self.keys, *self.slots]
        if not fsio.is_committed(spark, batch_path(self.folder, INITIAL)):
            self._add(table.select(columns).distinct(), INITIAL)
        near = self.read(source).filter(value_range(source, self.keys[-1]))
        mine = matched(near, source, self.keys, null_safe=True).distinct()
        self._add(unmatched(source.select(columns).distinct(), mine, columns), batch_id)
        found = mine.select(self.slots).unionByName(source.select(self.slots)).distinct().collect()
        return in_folders(self.slots, [tuple(r) for r in found])

    def _add(self, rows: DataFrame, batch_id: BatchId) -> None:
        append_batch(rows.repartitionByRange(F.col(self.keys[-1])).sortWithinPartitions(self.keys[-1]), self.folder, batch_id)

    def compact(self, source_schema: StructType, spark, name: str) -> None:
        """Pack the entries of all batches into one folder; while both are there entries are double."""
        old = [p for p in fsio.data_files(spark, self.folder)]
        schema = StructType([source_schema[c] for c in [*self.keys, *self.slots]])
        if len(old) < 3:
            return
        self._add(read_batches(spark, self.folder, schema).drop(BATCH_COLUMN).distinct(), name)
        for path in old:
            fsio.delete(spark, path)
        fsio.write_text(spark, f"{batch_path(self.folder, INITIAL)}/_SUCCESS", "")
