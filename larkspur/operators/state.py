"""Keyed tables: upserts, retention, anti joins and cascades, each returning the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import scoring


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, folded before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in others]).select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: tuple[str, ...] = (), sticky: tuple[str, ...] = (), fill: tuple[str, ...] = ()) -> DataFrame:
    """``old`` with ``new`` written over it; both have one row per key.

    keep_old: columns of which an existing value stays (ids, creation times);
    sticky: booleans that stay true; fill: new values only where not null.
    Other columns take the new row's value, null included.
    """
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    present = F.col(f"n.{keys[0]}").isNotNull()

    def value(c: str) -> Column:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in keys or c in fill:
            return F.coalesce(b, a)
        if c in keep_old:
            return F.coalesce(a, b)
        if c in sticky:
            return F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))
        return F.when(present, b).otherwise(a)

    return joined.select(*[value(c).alias(c) for c in old.columns])


def folded(rows: DataFrame, keys: list[str], order: list[str], keep_old: tuple[str, ...] = (), sticky: tuple[str, ...] = (), fill: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key: what ``upsert`` leaves of its rows when they are written in ``order``.

    Partial results merge in each task, so a hot key is one row there.  The
    order columns take the last row's value.  Folding a fold with the rows
    that went into it, at their places in the order, changes nothing.
    """
    at = F.struct(*order)

    def value(c: str) -> Column:
        own = F.col(c)
        if c in keep_old:
            out = F.min_by(own, F.when(own.isNotNull(), at))
        elif c in sticky:
            out = F.bool_or(F.coalesce(own, F.lit(False)))
        elif c in fill:
            out = F.max_by(own, F.when(own.isNotNull(), at))
        else:
            out = F.max_by(own, at)
        return out.alias(c)

    return rows.groupBy(*keys).agg(*[value(c) for c in rows.columns if c not in keys]).select(*rows.columns)


def take_over(lines: DataFrame, claims: DataFrame) -> DataFrame:
    """lines (line_id, device_id, guard_number, created_at): a claim removes every other holder of its guard number, then upserts its line."""
    claimed = claims.select(F.col("guard_number"), F.col("line_id").alias("_claimer"))
    rest = lines.join(claimed, "guard_number", "left").filter("_claimer is null or _claimer = line_id").drop("_claimer").select(*lines.columns)
    return upsert(rest, claims, ["line_id"], keep_old=("created_at",))


def unseen(rows: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been processed; goes before costly steps."""
    return rows.join(processed.select(key), key, "left_anti")


def retain(rows: DataFrame, at: str, now: Column, seconds: Column | int) -> DataFrame:
    return rows.filter(F.col(at) >= now - F.make_dt_interval(secs=F.lit(seconds) if isinstance(seconds, int) else seconds))


def retain_processed(rows: DataFrame, at: str, now: Column, lookback_seconds: int) -> DataFrame:
    """Processed keys outlive the lookback by an hour, and stay seven days at least."""
    return retain(rows, at, now, max(7 * 86_400, lookback_seconds + 3_600))


def cascade(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    return children.join(deleted.select(key), key, "left_anti")


def recheck(processed: DataFrame, key: str, prefix: str) -> DataFrame:
    """Forgets the keys of one account, so its messages are scanned again."""
    return processed.filter(~F.col(key).startswith(prefix))


def push_targets(accounts: DataFrame, devices: DataFrame) -> DataFrame:
    """Accounts (account_key, device_id, provider) with the token of their device, where it has one."""
    return accounts.join(devices.filter("apns_token is not null").select("device_id", "apns_token", "environment"), "device_id")


def expiry_status(expires: Column, now: Column, renew_hours: int = 24) -> Column:
    """Of a push subscription: none, expired, due for renewal, or active."""
    return F.when(expires.isNull(), "none").when(expires <= now, "expired").when(expires <= now + F.make_dt_interval(hours=F.lit(renew_hours)), "renew").otherwise("active")


def joined_titles(titles: Column, most: int = 160) -> Column:
    """Titles joined by a middle dot for as long as they fit; the first always shows."""
    return F.aggregate(
        titles,
        F.struct(F.lit("").alias("s"), F.lit(False).alias("full")),
        lambda acc, t: F.when(acc["full"], acc).when(acc["s"] == "", F.struct(F.substring(t, 1, most).alias("s"), F.lit(False).alias("full")))
        .when(F.length(acc["s"]) + 3 + F.length(t) <= most, F.struct(F.concat(acc["s"], F.lit(" · "), t).alias("s"), F.lit(False).alias("full")))
        .otherwise(F.struct(acc["s"].alias("s"), F.lit(True).alias("full"))),
        lambda acc: acc["s"],
    )


def clear_tokens(devices: DataFrame, refused: DataFrame) -> DataFrame:
    """``devices`` (device_id, apns_token, ...) without the tokens that were refused (device_id, apns_token); a token that has changed since stays."""
    gone = refused.select("device_id", "apns_token").distinct().withColumn("refused", F.lit(True))
    token = F.when(F.col("refused").isNull(), F.col("apns_token")).alias("apns_token")
    return devices.join(gone, ["device_id", "apns_token"], "left").select(*[token if c == "apns_token" else F.col(c) for c in devices.columns])


#: Statuses that end a call.
ENDED_STATUSES = ("completed", "failed", "no_answer", "canceled")


def duration_seconds(started_ms: Column, ended_ms: Column, now_ms: Column, status: Column) -> Column:
    """Whole seconds, halves up, never below 0; a call in progress lasts until now, one that has ended without a time has no duration."""
    end = F.coalesce(ended_ms, F.when(~F.coalesce(status.isin(*ENDED_STATUSES), F.lit(False)), now_ms))
    return F.greatest(F.floor((end - started_ms) / 1000 + 0.5), F.when(end.isNotNull() & started_ms.isNotNull(), F.lit(0))).cast("long")


def worth_keeping(alerted: Column, level: Column, minimum: str) -> Column:
    """A call stays if it was alerted or reached the level."""
    return F.coalesce(alerted, F.lit(False)) | F.coalesce(scoring.rank(level, scoring.LEVELS) >= scoring.LEVELS[minimum], F.lit(False))


def active_then_stored(active: DataFrame, stored: DataFrame, most: int) -> DataFrame:
    """Calls in progress first, then stored ones, each latest first, ``most`` in all; the two have the same columns.

    A call id shows once: as in progress, or as its latest stored row.  Rows
    of one id with equal starts are told apart by their other columns, so the
    same one always stays.
    """
    both = active.withColumn("_live", F.lit(1)).unionByName(stored.withColumn("_live", F.lit(0)))
    others = [c for c in active.columns if c not in ("call_id", "started_at")]
    best = both.groupBy("call_id").agg(F.max(F.struct("_live", "started_at", *others)).alias("_b"))
    first = best.select("call_id", F.col("_b.*")).orderBy(F.desc("_live"), F.desc("started_at"), "call_id").limit(most)
    return first.select(*active.columns)


def breaker(runs: DataFrame, scan: str, order: str, threshold: int = 3) -> DataFrame:
    """Adds ``allowed`` to model runs with an ``outcome``: false once ``threshold`` in a row have failed, for the rest of the scan.

    An answer (``answered``) ends a row of failures (``failed``); other outcomes, null included, neither count nor end one.
    """
    w = Window.partitionBy(scan).orderBy(order)
    failed = F.coalesce(F.col("outcome") == "failed", F.lit(False))
    island = F.count_if(F.coalesce(F.col("outcome") == "answered", F.lit(False))).over(w)
    rows = runs.withColumn("_island", island)
    rows = rows.withColumn("_fails", F.count_if(failed).over(Window.partitionBy(scan, "_island").orderBy(order)))
    most = F.max("_fails").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("allowed", F.coalesce(most, F.lit(0)) < threshold).drop("_island", "_fails")
