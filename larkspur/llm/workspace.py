"""Tables written between the steps of an operator, in the folder that the cluster shares.

Cutting lineage with a written table lets a job survive lost executors: what a
step returned is read again, never recomputed with another order of rows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; on a single machine a new one where that is unset."""
    found = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"{_CONF} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set(_CONF, found)
    return found


def bound_batches(spark: SparkSession) -> None:
    """Keeps the Arrow batches of this session's Python operators small, unless its configuration states a size."""
    if spark.sparkContext.getConf().get(_BATCH) is None:
        spark.conf.set(_BATCH, "2m")


class Scratch:
    """The tables that an operator writes on its way; leaving it deletes all that were not kept.

    A result must be kept, or stand on kept tables only.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def stage(self, df: DataFrame) -> DataFrame:
        """``df`` written to the shared folder as Parquet, and read back."""
        bound_batches(self.spark)
        path = f"{shared_dir(self.spark)}/larkspur/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (out, path)
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, staged here, which outlives this scratch."""
        self._paths.pop(id(df), None)
        return df

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables staged here that nothing reads any more."""
        jvm = self.spark._jvm
        for df in tables:
            if (found := self._paths.pop(id(df), None)) is not None:
                path = jvm.org.apache.hadoop.fs.Path(found[1])
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failure) -> None:
        self.drop(*(df for df, _ in list(self._paths.values())))


def stage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet, and read back; its owner is whoever holds the result."""
    scratch = Scratch(df.sparkSession)
    return scratch.keep(scratch.stage(df))


def broadcast_if(df: DataFrame, rows: int):
    """A broadcast hint where a count proves that staged ``df`` has at most ``rows`` rows; else ``df`` as it is."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, or what it becomes with underscores before it, unlike all ``taken`` names in any case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def own(df: DataFrame, name: str) -> Column:
    """A column of ``df`` by its name as it is, dots and backticks included."""
    return df["`" + name.replace("`", "``") + "`"]
