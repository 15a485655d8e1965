"""Windows over transcript segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The n newest rows of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("_r") <= n).drop("_r")


def upsert_segments(segments: DataFrame) -> DataFrame:
    """segments (call_id, id, arrival, text, speaker, final): one row per id, at the position of its first arrival.

    The last final stands, or the last partial where there is no final.
    """
    best = F.max_by(F.struct("text", "speaker", "final"), F.struct("final", "arrival"))
    out = segments.groupBy("call_id", "id").agg(F.min("arrival").alias("ord"), best.alias("s"))
    return out.select("call_id", "id", "ord", "s.text", "s.speaker", "s.final")


def merged_lines(segments: DataFrame) -> DataFrame:
    """Consecutive segments of a speaker (call_id, ord, speaker, text) joined by a blank: call_id, line, speaker, text."""
    w = Window.partitionBy("call_id").orderBy("ord")
    t = F.trim("text")
    rows = segments.filter(t != "").select("call_id", "ord", "speaker", t.alias("text"))
    new = F.coalesce((F.col("speaker") != F.lag("speaker").over(w)).cast("int"), F.lit(1))
    rows = rows.withColumn("line", F.sum(new).over(w))
    parts = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return rows.groupBy("call_id", "line", "speaker").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def render(segments: DataFrame, most: int) -> DataFrame:
    """The transcript of each call (call_id, transcript): the newest lines that fit ``most`` characters, at least the end of the last."""
    label = F.when(F.col("speaker") == "caller", "Caller").otherwise("You")
    lines = merged_lines(segments).select("call_id", "line", F.concat(label, F.lit(": "), F.col("text")).alias("s"))
    w = Window.partitionBy("call_id").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = lines.withColumn("total", F.sum(F.length("s") + 1).over(w)).withColumn("k", F.row_number().over(Window.partitionBy("call_id").orderBy(F.desc("line")))).filter((F.col("total") <= most) | (F.col("k") == 1))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "s"))), lambda p: p["s"]), "\n")
    return kept.groupBy("call_id").agg(F.right(text, F.lit(most)).alias("transcript"))


def utterances(events: DataFrame) -> DataFrame:
    """Transcription events (call_id, speaker, arrival, text, final, sequence) as segments: call_id, speaker, arrival, id, text, final.

    A partial with a sequence number lower than one seen is late and goes.  A
    speaker's segments share an id up to their final one; the next begins
    another.  Events without text are none; an event without number is never late.
    """
    before = Window.partitionBy("call_id", "speaker").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    t = F.trim("text")
    rows = events.filter(t != "").select("call_id", "speaker", "arrival", t.alias("text"), F.coalesce("final", F.lit(False)).alias("final"), "sequence", F.coalesce(F.max("sequence").over(before), F.lit(-1)).alias("seen"))
    kept = rows.filter("final or sequence is null or sequence >= seen")
    n = F.coalesce(F.count_if("final").over(before), F.lit(0)) + 1
    return kept.select("call_id", "speaker", "arrival", F.concat("speaker", F.lit("-tw-"), n.cast("string")).alias("id"), "text", "final")


def chunks(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """Adds ``chunk``, from 0: each n rows of a key in order."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("chunk", F.floor((at - 1) / n))


def with_latest(rows: DataFrame, states: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """``rows`` with the columns of the latest of ``states`` at or before each, null where there is none.

    Both have ``key`` and ``order``.  One sort of their union per key; no range
    join, so a key with many of both costs no product.  Of states at one place
    the greatest counts; null keys are a key of their own.
    """
    both = rows.withColumns({"_of": F.lit(1), "_s": F.lit(None)}).withColumn("_s", F.col("_s").cast(states.select(F.struct(*columns).alias("s")).schema["s"].dataType))
    both = both.unionByName(states.select(key, order, F.lit(0).alias("_of"), F.struct(*columns).alias("_s")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(order, "_of", "_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("_last", F.last("_s", ignorenulls=True).over(w)).filter("_of = 1")
    return out.select(*rows.columns, *[F.col(f"_last.{c}").alias(c) for c in columns])
