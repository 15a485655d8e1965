"""Scores held against labels: a sweep of all thresholds, and what each class bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts of [0, 1] whose totals are summed before the scores within each part.
PARTS = 1000


def sweep(rows: DataFrame) -> DataFrame:
    """rows (score in 0 to 1, positive boolean): for each distinct score as the threshold, what would alert.

    Columns threshold, n_positive and n_negative (with just this score), tp,
    fp, fn, tn, precision and recall (six places; null where nothing alerts or
    nothing is positive).  Equal scores share a row; rows without score or
    label count for nothing.  Sums run over the parts of the scale first, then
    inside each, so no task has more than one part's distinct scores.
    """
    known = rows.filter("score is not null and positive is not null")
    each = known.groupBy(F.col("score").alias("threshold")).agg(F.count_if("positive").alias("n_positive"), F.count_if(~F.col("positive")).alias("n_negative"))
    each = each.withColumn("_part", F.least(F.floor(F.col("threshold") * PARTS), F.lit(PARTS)))
    down = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = each.groupBy("_part").agg(F.sum("n_positive").alias("_p"), F.sum("n_negative").alias("_n"))  # at most PARTS + 1 rows
    parts = parts.select("_part", F.coalesce(F.sum("_p").over(down), F.lit(0)).alias("_above_p"), F.coalesce(F.sum("_n").over(down), F.lit(0)).alias("_above_n"), F.sum("_p").over(every).alias("_all_p"), F.sum("_n").over(every).alias("_all_n"))
    within = Window.partitionBy("_part").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = each.join(F.broadcast(parts), "_part").withColumns({"tp": F.col("_above_p") + F.sum("n_positive").over(within), "fp": F.col("_above_n") + F.sum("n_negative").over(within)})
    out = out.withColumns({"fn": F.col("_all_p") - F.col("tp"), "tn": F.col("_all_n") - F.col("fp")})
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    return out.select("threshold", "n_positive", "n_negative", "tp", "fp", "fn", "tn", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def bounds(rows: DataFrame, alert_at: float) -> DataFrame:
    """rows (score, positive): for each class its lowest and highest score, and how many are on the right side of ``alert_at``."""
    right = F.when(F.col("positive"), F.col("score") >= alert_at).otherwise(F.col("score") < alert_at)
    return rows.filter("score is not null and positive is not null").groupBy("positive").agg(F.count("*").alias("n"), F.min("score").alias("floor"), F.max("score").alias("ceiling"), F.count_if(right).alias("n_right"))
