"""Facts about the few distinct keys of many rows: computed once per key, and joined without moving the rows by key."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CONF = "spark.checkpoint.dir"
#: Most facts that a count may prove small enough for a broadcast, and most keys that can be hot otherwise.
MOST, HOT = 50_000, 1000
#: Places over which rows that meet no key of a shuffled join are spread.
SPREAD = 4096


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the folder of spark.checkpoint.dir and read back, so that no filter is pushed below it; on a single machine to a new one where that is unset."""
    spark = df.sparkSession
    folder = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"{_CONF} must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set(_CONF, folder)
    path = f"{folder}/larkspur/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def distinct(keys: DataFrame, name: str) -> DataFrame:
    """The distinct values of column ``name`` with their number of rows ``n``, staged: what is asked of them is asked once per value."""
    return staged(keys.groupBy(name).agg(F.count("*").alias("n")))


def with_facts(rows: DataFrame, facts: DataFrame, key: str, row_id: str, most: int = MOST, hot: int = HOT) -> DataFrame:
    """Left join of ``rows`` with staged ``facts``: one row per key, the key's number of rows in ``n``, and columns that ``rows`` has not.

    Few facts are broadcast.  Of many, those of the ``hot`` commonest keys are,
    and only rows with other keys meet in a shuffle; the rest of the rows are
    spread over it, so no task has all rows of a common or null key.
    """
    names = [c for c in facts.columns if c not in (key, "n")]
    if facts.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(facts.drop("n")), key, "left")
    packed = facts.select(F.col(key).alias("_key"), "n", F.struct(*names).alias("_f"))
    top = staged(packed.orderBy(F.desc("n"), "_key").limit(hot))
    out = rows.join(F.broadcast(top.select(F.col("_key").alias(key), F.col("_f").alias("_hot"))), key, "left")
    met = F.col(key).isNull() | F.col("_hot").isNotNull()
    out = out.withColumn("_spread", F.when(met, F.pmod(F.xxhash64(row_id), F.lit(SPREAD)) + 1).otherwise(0))
    rest = packed.join(F.broadcast(top.select("_key")), "_key", "left_anti").select(F.col("_key").alias(key), F.lit(0).cast("long").alias("_spread"), F.col("_f").alias("_rest"))
    out = out.join(rest, [key, "_spread"], "left").withColumn("_f", F.coalesce("_hot", "_rest"))
    return out.select(*rows.columns, *[F.col(f"_f.{c}").alias(c) for c in names])
