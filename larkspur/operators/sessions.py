"""Calls as sessions: life cycle, segments, verdicts and alerts, folded in the order of their events.

``events``: call_id string, n long (order within the call), at timestamp, kind
string (created, segment, status or verdict), speaker, text, final, sequence
(the transcriber's number) of segments, status, score of verdicts by a model.

The result has a row for each effect: kind created, segment, status, verdict,
alert or ended.  ``larkspur.streaming.sessions`` does the same on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import scoring
from larkspur.functions.call_patterns import CALL_RULES
from larkspur.operators.calls import ALERT_MINIMUM, USER_FACTOR, line_flags, short
from larkspur.operators.state import ENDED_STATUSES

#: Segments of a call whose matches count.
WINDOW = 2000
#: An ended call stays so long at least, so that a last verdict finds it.
LEAST_RETAIN_MS = 15_000
FIRST_STATUS = "ringing"
OUT = "call_id string, n long, kind string, id string, status string, score double, level string, rules string, sequence long"


def fired(events: DataFrame) -> DataFrame:
    """Adds ``fired``: the numbers of the rules that fire on a final segment's line."""
    flags = line_flags(events)
    numbers = F.array_compact(F.array(*[F.when(F.col(short(r[0])), F.lit(i)) for i, r in enumerate(CALL_RULES)]))
    return flags.select(*events.columns, F.when(F.col("kind") == "segment", numbers).otherwise(F.array().cast("array<int>")).alias("fired"))


def _row(kind: str, **columns: Column) -> list[Column]:
    """The result's columns in order, null where not given."""
    given = {"call_id": F.col("call_id"), "n": F.col("n"), "kind": F.lit(kind)} | columns
    return [given.get(name, F.lit(None)).cast(t).alias(name) for name, t in (c.split() for c in OUT.split(", "))]


def lifecycle(events: DataFrame, retain_ms: int = LEAST_RETAIN_MS) -> DataFrame:
    """Events that count, with ``over`` (the call had ended before) and ``ends``.

    Nothing counts before a call is created or twice; a call ends once; after
    its end only verdicts count, until it has been retained for ``retain_ms``.
    """
    retain = F.make_dt_interval(secs=F.lit(max(retain_ms, LEAST_RETAIN_MS) / 1000))
    by = Window.partitionBy("call_id").orderBy("n")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("_made", F.coalesce(F.max(F.col("kind") == "created").over(before), F.lit(False)))
    rows = rows.filter((F.col("kind") == "created") != F.col("_made")).drop("_made")
    ends = F.coalesce((F.col("kind") == "status") & F.col("status").isin(*ENDED_STATUSES), F.lit(False))
    rows = rows.withColumn("_ends", ends).withColumn("_ended_at", F.first(F.when(F.col("_ends"), F.col("at")), ignorenulls=True).over(before))
    rows = rows.filter(F.col("_ended_at").isNull() | ((F.col("kind") == "verdict") & (F.col("at") <= F.col("_ended_at") + retain)))
    return rows.select(*events.columns, F.col("_ended_at").isNotNull().alias("over"), F.col("_ends").alias("ends"))


def segments(events: DataFrame, window: int = WINDOW) -> DataFrame:
    """Segment events that stand: late partials go; adds id, rank (of the id, by its first event) and newest (the highest rank so far).

    An utterance that is still open when ``window`` newer ones have begun has left the window for good.
    """
    track = Window.partitionBy("call_id", "speaker").orderBy("n")
    before, so_far = track.rowsBetween(Window.unboundedPreceding, -1), track.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = events.filter((F.col("kind") == "segment") & (F.trim("text") != "")).withColumn("final", F.coalesce("final", F.lit(False)))
    seen = F.coalesce(F.max("sequence").over(before), F.lit(-1))
    rows = rows.withColumn("_seen", seen).filter("final or sequence is null or sequence >= _seen").drop("_seen")
    number = F.coalesce(F.count_if("final").over(before), F.lit(0)) + 1
    rows = rows.withColumns({"id": F.concat("speaker", F.lit("-tw-"), number.cast("string")), "_new": F.coalesce(F.lag("final").over(track), F.lit(True))})
    rows = rows.withColumn("newest", F.count_if("_new").over(Window.partitionBy("call_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("rank", F.max(F.when(F.col("_new"), F.col("newest"))).over(so_far))
    return rows.filter(F.col("rank") > F.col("newest") - window).drop("_new")


def _rule_verdicts(stood: DataFrame, window: int) -> DataFrame:
    """call_id, n, score, level, rules at each final segment that changes them.

    The highest rank of a match tells whether any match is still in the
    window: a running maximum per rule, in one sort of a call for all.
    """
    w = Window.partitionBy("call_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks, weights = {}, {}
    for i, r in enumerate(CALL_RULES):
        hit = F.array_contains("fired", i)
        ranks[f"_c{i}"] = F.max(F.when(hit & ((F.col("speaker") == "caller") | F.lit(r[6])), F.col("rank"))).over(w)
        ranks[f"_u{i}"] = F.max(F.when(hit, F.col("rank"))).over(w)
        oldest = F.col("newest") - window
        weights[i] = F.when(F.col(f"_c{i}") > oldest, r[3]).when(F.col(f"_u{i}") > oldest, round(r[3] * USER_FACTOR, 4)).otherwise(0.0)
    finals = stood.filter("final").withColumns(ranks)
    every = [F.struct((-F.lit(scoring.RANKS[r[2]])).alias("s"), (-weights[i]).alias("w"), F.lit(i).alias("i"), F.lit(r[0]).alias("id")) for i, r in enumerate(CALL_RULES)]
    rules = F.array_join(F.transform(F.array_sort(F.filter(F.array(*every), lambda x: x["w"] < 0)), lambda x: x["id"]), ",")
    rows = finals.select("call_id", "n", F.round(scoring.noisy_or(F.array(*weights.values())), 9).alias("score"), rules.alias("rules"))
    rows = rows.withColumn("level", scoring.level(F.col("score")))
    mark = F.concat_ws("|", "level", F.format_number("score", 2), "rules")
    changed = rows.withColumn("_changed", ~mark.eqNullSafe(F.lag(mark).over(Window.partitionBy("call_id").orderBy("n"))))
    return changed.filter("_changed").select("call_id", "n", "score", "level", "rules")


def session_log(events: DataFrame, minimum: str = ALERT_MINIMUM, window: int = WINDOW, retain_ms: int = LEAST_RETAIN_MS) -> DataFrame:
    """Every effect of the events (see the module).

    A verdict alerts where its level is ``minimum`` at least and above all
    levels that the call has alerted, unless the call has ended.  Repeated n
    of a call are in no defined order; null kinds, texts and speakers count for nothing.
    """
    known = lifecycle(events.filter("kind is not null and (kind <> 'segment' or speaker is not null)"), retain_ms)
    stood = segments(fired(known), window)
    models = known.filter("kind = 'verdict' and score is not null").select("call_id", "n", "score", scoring.level(F.col("score")).alias("level"), F.lit(None).cast("string").alias("rules"), "over")
    verdicts = _rule_verdicts(stood, window).withColumn("over", F.lit(False)).unionByName(models)
    by = Window.partitionBy("call_id").orderBy("n")
    r = scoring.rank(F.col("level"), scoring.LEVELS)
    due = F.when((r >= max(scoring.LEVELS[minimum], 1)) & ~F.col("over"), r).otherwise(0)
    verdicts = verdicts.withColumns({"sequence": F.row_number().over(by), "_due": due})
    verdicts = verdicts.withColumn("_before", F.coalesce(F.max("_due").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = {c: F.col(c) for c in ("score", "level", "sequence")}
    status = known.filter("kind = 'status' and status is not null").withColumn("_was", F.coalesce(F.lag("status").over(by), F.lit(FIRST_STATUS)))
    parts = [
        known.filter("kind = 'created'").select(*_row("created", status=F.lit(FIRST_STATUS))),
        stood.select(*_row("segment", id=F.col("id"))),
        verdicts.select(*_row("verdict", rules=F.col("rules"), **kept)),
        verdicts.filter("_due > _before").select(*_row("alert", **kept)),
        status.filter("not ends and status <> _was").select(*_row("status", status=F.col("status"))),
        status.filter("ends").select(*_row("ended", status=F.col("status"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
