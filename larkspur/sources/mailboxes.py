"""Incremental mailbox scans as relations: cursors, caps and budgets, without a network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCAN_CAP = 100


def history_scan(history: DataFrame, cursor: Column | int, processed: DataFrame | None = None, cap: int = SCAN_CAP) -> DataFrame:
    """history (account_id, record_id, message_id, labels array<string>) since a cursor: new inbox messages, once each.

    Drafts, sent mail and processed messages are left out.  The scan stops
    after the record that reaches the cap; each row has that record's id as next_cursor.
    """
    rows = history.filter((F.col("record_id") > cursor) & F.array_contains("labels", "INBOX") & ~F.arrays_overlap("labels", F.array(F.lit("DRAFT"), F.lit("SENT"))))
    first = rows.groupBy("account_id", "message_id").agg(F.min("record_id").alias("record_id"))
    if processed is not None:
        first = first.join(processed.select("account_id", "message_id"), ["account_id", "message_id"], "left_anti")
    w = Window.partitionBy("account_id").orderBy("record_id").rangeBetween(Window.unboundedPreceding, -1)
    kept = first.withColumn("before", F.count("*").over(w)).filter(F.col("before") < cap).drop("before")
    return kept.withColumn("next_cursor", F.max("record_id").over(Window.partitionBy("account_id")))


def full_scan(messages: DataFrame, now: Column, lookback_days: int, cap: int = SCAN_CAP) -> DataFrame:
    """The newest messages of each account (account_id, message_id, received_at) within the lookback."""
    rows = messages.filter(F.col("received_at") >= now - F.make_dt_interval(days=F.lit(lookback_days)))
    return _newest(rows, "received_at", cap)


def _newest(rows: DataFrame, order: str, cap: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc(order)))).filter(F.col("_r") <= cap).drop("_r")


def with_reset(scan: DataFrame, expired: DataFrame, fallback: DataFrame) -> DataFrame:
    """Accounts whose cursor has expired take their rows from a full scan; cursor_was_reset says which."""
    fresh = scan.join(expired.select("account_id"), "account_id", "left_anti").withColumn("cursor_was_reset", F.lit(False))
    return fresh.unionByName(fallback.join(expired.select("account_id"), "account_id", "left_semi").withColumn("cursor_was_reset", F.lit(True)), allowMissingColumns=True)


def delta_scan(pages: DataFrame, processed: DataFrame, cap: int = SCAN_CAP) -> DataFrame:
    """pages (account_id, page, message_id, removed, is_draft): whole pages until the cap is reached, tombstones and drafts left out."""
    rows = pages.filter("not removed and not is_draft").groupBy("account_id", "message_id").agg(F.min("page").alias("page"))
    rows = rows.join(processed.select("account_id", "message_id"), ["account_id", "message_id"], "left_anti")
    before = F.count("*").over(Window.partitionBy("account_id").orderBy("page").rangeBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", before).filter(F.col("before") < cap).drop("before")


def uid_scan(rows: DataFrame, cursor: Column, cap: int = SCAN_CAP) -> DataFrame:
    """rows (account_id, uid) beyond the cursor, oldest first up to the cap; next_uid never falls behind the cursor."""
    later = rows.filter(F.col("uid") > cursor)
    kept = later.withColumn("_r", F.row_number().over(Window.partitionBy("account_id").orderBy("uid"))).filter(F.col("_r") <= cap).drop("_r")
    return kept.withColumn("next_uid", F.greatest(cursor.cast("long"), F.max("uid").over(Window.partitionBy("account_id"))))


def first_uid_scan(rows: DataFrame, since: Column, cap: int = SCAN_CAP) -> DataFrame:
    """Without a cursor, or with another uid validity: rows (account_id, uid, received_at) since a time, newest first up to the cap."""
    return _newest(rows.filter(F.col("received_at") >= since), "uid", cap)


def within_budget(rows: DataFrame, key: str, order: list[str], size: str, budget: int) -> DataFrame:
    """The rows of each key, in order, whose sizes add up to at most the budget; the first always."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("total", F.sum(size).over(w)).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return out.filter((F.col("total") <= budget) | (F.col("_r") == 1)).drop("_r")


def hydrate(ids: DataFrame, bodies: DataFrame) -> DataFrame:
    """Bodies of the ids; an id that is gone gives no row."""
    return ids.join(bodies, ["account_id", "message_id"])


def pubsub(envelopes: DataFrame) -> DataFrame:
    """envelopes (body): the mailbox and history id in a base64 JSON envelope; null for anything else."""
    outer = F.from_json("body", "message struct<data:string,messageId:string>")
    inner = F.from_json(F.decode(F.try_to_binary(outer["message"]["data"], F.lit("base64")), "UTF-8"), "emailAddress string, historyId string")
    return envelopes.select("*", inner["emailAddress"].alias("email"), inner["historyId"].try_cast("long").alias("history_id"))


def notifications(batches: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """batches (body): JSON lists of at most 500 notifications, with the account of the subscription whose state hash they match."""
    body = F.from_json("body", "value array<struct<subscriptionId:string,clientState:string,lifecycleEvent:string,changeType:string>>")
    rows = batches.select(F.explode(F.slice(body["value"], 1, 500)).alias("n")).select("n.*")
    found = rows.join(subscriptions, rows["subscriptionId"] == subscriptions["subscription_id"], "left")
    return found.withColumn("accepted", F.coalesce(F.sha2("clientState", 256) == F.col("client_state"), F.lit(False)))


def scripted(dialogue: DataFrame, speed: float = 1.0) -> DataFrame:
    """dialogue (call_id, ord, speaker, text, pause_ms): the events of a replay.

    A line of three words or more first comes as a partial with half its words, and 400 ms later as a final.
    """
    at = F.sum("pause_ms").over(Window.partitionBy("call_id").orderBy("ord")) / F.lit(min(4.0, max(0.25, speed)))
    words = F.split(F.trim("text"), r"\s+")
    half = F.array_join(F.slice(words, 1, F.ceil(F.size(words) / 2).cast("int")), " ")
    partial = F.when(F.size(words) >= 3, F.struct(F.lit(False).alias("final"), half.alias("said"), F.lit(0).alias("delay")))
    full = F.struct(F.lit(True).alias("final"), F.trim("text").alias("said"), F.lit(400).alias("delay"))
    rows = dialogue.withColumn("at", at).withColumn("e", F.explode(F.array_compact(F.array(partial, full))))
    return rows.select("call_id", "ord", "speaker", F.col("e.said").alias("text"), F.col("e.final").alias("final"), (F.col("at") + F.col("e.delay")).cast("long").alias("at_ms"))
