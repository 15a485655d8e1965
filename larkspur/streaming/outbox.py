"""A keyed table that a stream writes through ``foreachBatch``, where writing a batch again changes nothing.

Each batch is a folder named by its id, which a replay overwrites with the
same rows; the table is the fold of all batches in order.  Nothing is updated
in place, so a writer that dies leaves the earlier batches as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.state import folded

_BATCH, _KEPT = "batch_id", "_order"


class UpsertLog:
    """The table at ``path``, a folder that all executors share.

    keys: its key; order: a column that orders the rows of a batch; keep_old,
    sticky and fill: as in ``folded``.  One writer at a time.
    """

    def __init__(self, path: str, keys: list[str], order: str, keep_old: tuple[str, ...] = (), sticky: tuple[str, ...] = (), fill: tuple[str, ...] = ()):
        self.path, self.keys, self.order, self.rules = path.rstrip("/"), keys, order, {"keep_old": keep_old, "sticky": sticky, "fill": fill}

    def _folder(self, batch_id: int) -> str:
        return f"{self.path}/{_BATCH}={batch_id}"

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """One batch, for ``foreachBatch``; rows of one key are folded first, so a hot key is one row."""
        one = folded(rows.withColumn(_KEPT, F.col(self.order)), self.keys, [_KEPT], **self.rules)
        one.write.mode("overwrite").parquet(self._folder(batch_id))

    def batches(self, spark: SparkSession) -> list[int]:
        """Ids of the batches that were written to their end."""
        fs, at = self._fs(spark)
        if not fs.exists(at):
            return []
        done = [s.getPath() for s in fs.listStatus(at) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().partition("=")[2]) for p in done)

    def current(self, spark: SparkSession) -> DataFrame:
        """The table as the batches leave it."""
        parts = [spark.read.parquet(self._folder(b)).withColumn(_BATCH, F.lit(b)) for b in self.batches(spark)]
        if not parts:
            raise ValueError(f"{self.path} has no batch yet")
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return folded(every, self.keys, [_BATCH, _KEPT], **self.rules).drop(_BATCH, _KEPT)

    def compact(self, spark: SparkSession, upto: int) -> None:
        """Makes the batches up to ``upto`` one, with its id.

        The fold goes to a folder beside them, takes the place of batch
        ``upto``, and only then do the older ones go.  Batches already in the
        fold change nothing when they are folded again, so it may stop anywhere and be run again.
        """
        ids = [b for b in self.batches(spark) if b <= upto]
        if len(ids) < 2 or ids[-1] != upto:
            return
        every = None
        for b in ids:
            p = spark.read.parquet(self._folder(b)).withColumn(_BATCH, F.lit(b))
            every = p if every is None else every.unionByName(p)
        one = folded(every, self.keys, [_BATCH, _KEPT], **self.rules).drop(_BATCH)
        beside = f"{self.path}/compacting-{upto}"
        one.write.mode("overwrite").parquet(beside)
        fs, _ = self._fs(spark)
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs.delete(path(self._folder(upto)), True)
        fs.rename(path(beside), path(self._folder(upto)))
        for b in ids[:-1]:
            fs.delete(path(self._folder(b)), True)

    def _fs(self, spark: SparkSession):
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()), at
