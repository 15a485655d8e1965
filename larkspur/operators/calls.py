"""Call rules over transcript lines, merged verdicts, running verdicts and alerts.

``lines``: call_id string, ord long (position), speaker string (caller or user), text string, final boolean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import call_matching, scoring, text
from larkspur.functions.call_patterns import CALL_RULES

USER_FACTOR = 0.5
#: Rules that are about codes only: alone they mean phishing, with any other a scam.
CODE_RULES = ("call.otp_or_credentials", "call.user_sharing_sensitive")
ALERT_MINIMUM = "medium"

# fixed values
SHARED = "You said: something that sounds like a card number, a code or a password was read out."
NOTHING_FOUND = "No signs of a scam so far."
LIKE_PHISHING = "like an attempt to get your codes or passwords"
LIKE_SCAM = "like a scam"


def short(rule_id: str) -> str:
    return rule_id.removeprefix("call.")


def line_flags(lines: DataFrame) -> DataFrame:
    """Adds a boolean column per rule: whether it fires on the line.

    Lines are matched where they are, without a shuffle, in batches and on
    streams alike; a line that is not final fires nothing, nor does a null one.
    """
    line = text.normal_line(F.coalesce("text", F.lit("")))
    out = lines.withColumn("_hits", call_matching.hits(F.when(F.col("final"), line)))
    protective = _bit(call_matching.PROTECTIVE_BIT)
    flags = {}
    for i, (id_, _, _, _, guarded, _, user_only, _) in enumerate(CALL_RULES):
        fires = _bit(i)
        if guarded:
            fires = fires & ~protective
        if user_only:
            fires = fires & (F.col("speaker") == "user")
        flags[short(id_)] = F.coalesce(fires, F.lit(False))
    out = out.withColumns(flags)
    tiers = {short(id_): F.col(short(id_)) & ~F.col(short(by)) for id_, _, _, _, _, by, _, _ in CALL_RULES if by}
    return out.withColumns(tiers).drop("_hits")


def _bit(i: int) -> Column:
    return F.getbit("_hits", F.lit(i)) == 1


def signals(lines: DataFrame) -> DataFrame:
    """One row per call and rule that fired: call_id, rule, severity, weight, speaker, ord.

    A caller's line stands before a user's, then the first line; a user's line
    has half the weight, unless the rule is for users.
    """
    flags = line_flags(lines)
    names = [short(r[0]) for r in CALL_RULES]
    fired = F.array_compact(F.array(*[F.when(F.col(n), F.lit(i)) for i, n in enumerate(names)]))
    best = flags.select("call_id", "ord", "speaker", F.explode(fired).alias("i")).groupBy("call_id", "i").agg(F.min(F.struct((F.col("speaker") == "user").alias("user"), "ord")).alias("b"))
    return _catalogued(best, "severity").select("call_id", "rule", "severity", "weight", "speaker", "ord")


def _catalogued(best: DataFrame, *columns: str) -> DataFrame:
    """Adds rule, weight, speaker, ord and columns of the catalogue to rows (call_id, i, b with user and ord)."""
    table = F.array(*[F.struct(F.lit(r[0]).alias("rule"), F.lit(r[1]).alias("title"), F.lit(r[2]).alias("severity"), F.lit(r[3]).alias("weight"), F.lit(r[6]).alias("users")) for r in CALL_RULES])
    rows = best.withColumn("r", F.element_at(table, F.col("i") + 1))
    weight = F.when(F.col("b.user") & ~F.col("r.users"), F.round(F.col("r.weight") * USER_FACTOR, 4)).otherwise(F.col("r.weight"))
    return rows.select("call_id", "b", "b.ord", F.col("r.rule").alias("rule"), weight.alias("weight"), F.when(F.col("b.user"), "user").otherwise("caller").alias("speaker"), *[F.col(f"r.{c}").alias(c) for c in columns])


def evidence(lines: DataFrame) -> DataFrame:
    """``signals`` with title and detail: who said it, and a quote around the first match with its digits masked."""
    flags = line_flags(lines)
    bits = sum((F.when(F.col(short(r[0])), F.lit(1 << i).cast("bigint")).otherwise(0) for i, r in enumerate(CALL_RULES)), F.lit(0).cast("bigint"))
    said = flags.select("call_id", "ord", "speaker", bits.alias("fired"), text.normal_line(F.coalesce("text", F.lit(""))).alias("line")).filter("fired <> 0")
    rows = said.select("call_id", "ord", "speaker", F.explode(call_matching.evidence(F.col("line"), F.col("fired"))).alias("e"))
    who = F.when(F.col("speaker") == "caller", "Caller said: “").otherwise("You said: “")
    fixed = F.when(F.col("e.rule").isin([i for i, r in enumerate(CALL_RULES) if r[6]]), SHARED)
    detail = F.coalesce(fixed, F.concat(who, text.truncate(text.mask_digits(F.col("e.quote")), call_matching.QUOTE + 2), F.lit("”")))
    best = rows.groupBy("call_id", F.col("e.rule").alias("i")).agg(F.min(F.struct((F.col("speaker") == "user").alias("user"), "ord", detail.alias("detail"))).alias("b"))
    return _catalogued(best, "title", "severity").withColumn("detail", F.col("b.detail")).select("call_id", "rule", "title", "severity", "weight", "speaker", "ord", "detail")


def summaries(found: DataFrame) -> DataFrame:
    """found: ``evidence``.  call_id and a sentence: the category of each call, and its two severest and heaviest signals by title."""
    place = F.array_position(F.array(*[F.lit(r[0]) for r in CALL_RULES]), F.col("rule"))
    order = F.struct((-scoring.rank(F.col("severity"))).alias("s"), (-F.col("weight")).alias("w"), place.alias("i"), F.col("title").alias("title"))
    calls = found.groupBy("call_id").agg(F.round(scoring.noisy_or_agg(F.col("weight")), 9).alias("score"), F.bool_and(F.col("rule").isin(list(CODE_RULES))).alias("codes"), F.array_sort(F.collect_list(order)).alias("by"))
    titles = F.array_join(F.transform(F.slice("by", 1, 2), lambda x: x["title"]), "; ")
    level = scoring.level(F.col("score"))
    like = F.when(F.col("codes"), LIKE_PHISHING).otherwise(LIKE_SCAM)
    return calls.select("call_id", level.alias("level"), F.when(level == "safe", NOTHING_FOUND).otherwise(F.concat(F.lit("This call looks "), like, F.lit(": "), titles, F.lit("."))).alias("summary"))


def verdicts(lines: DataFrame) -> DataFrame:
    """call_id, score, level, category and n_signals of each call in which a rule fired."""
    out = signals(lines).groupBy("call_id").agg(
        F.round(scoring.noisy_or_agg(F.col("weight")), 9).alias("score"), F.count("*").alias("n_signals"), F.bool_and(F.col("rule").isin(list(CODE_RULES))).alias("codes")
    )
    level = scoring.level(F.col("score"))
    return out.select("call_id", "score", level.alias("level"), F.when(level == "safe", "safe").when(F.col("codes"), "phishing").otherwise("scam").alias("category"), "n_signals")


def running_verdicts(lines: DataFrame) -> DataFrame:
    """After each final line the verdict so far: call_id, ord, score, level, rules, changed, sequence.

    One sort per call serves all rules: whether a caller or a user has matched
    so far is a running maximum.  changed: level, score to two places or the
    rules differ from the line before; sequence counts the changes.
    """
    flags = line_flags(lines).filter("final")
    w = Window.partitionBy("call_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    caller, weights = F.col("speaker") == "caller", {}
    seen = {}
    for id_, _, _, weight, _, _, user_only, _ in CALL_RULES:
        n = short(id_)
        seen[f"c_{n}"] = F.max(F.col(n) & (caller | F.lit(user_only))).over(w)
        seen[f"u_{n}"] = F.max(F.col(n)).over(w)
        weights[n] = F.when(F.col(f"c_{n}"), weight).when(F.col(f"u_{n}"), round(weight * USER_FACTOR, 4)).otherwise(0.0)
    names = [short(r[0]) for r in CALL_RULES]
    state = flags.select("call_id", "ord", "speaker", *names).withColumns(seen)
    score = F.round(scoring.noisy_or(F.array(*weights.values())), 9)
    # by severity, then weight, then catalogue order
    rules = F.transform(
        F.array_sort(F.filter(F.array(*[F.struct((-F.lit(scoring.RANKS[r[2]])).alias("s"), (-weights[short(r[0])]).alias("w"), F.lit(i).alias("i"), F.lit(r[0]).alias("id")) for i, r in enumerate(CALL_RULES)]), lambda x: x["w"] < 0)),
        lambda x: x["id"],
    )
    out = state.select("call_id", "ord", score.alias("score"), F.array_join(rules, ",").alias("rules")).withColumn("level", scoring.level(F.col("score")))
    mark = F.concat_ws("|", "level", F.format_number(F.col("score"), 2), "rules")
    order = Window.partitionBy("call_id").orderBy("ord")
    changed = ~mark.eqNullSafe(F.lag(mark).over(order))
    out = out.withColumn("changed", changed)
    return out.withColumn("sequence", F.sum(F.col("changed").cast("long")).over(w))


def alerts(running: DataFrame, minimum: str = ALERT_MINIMUM) -> DataFrame:
    """The lines at which a call's level rises above all levels alerted before and reaches the minimum: call_id, ord, level."""
    r = scoring.rank(F.col("level"), scoring.LEVELS)
    due = F.when(r >= F.greatest(F.lit(scoring.LEVELS[minimum]), F.lit(1)), r).otherwise(0)
    before = F.max(due).over(Window.partitionBy("call_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    rows = running.select("call_id", "ord", "level", due.alias("due"), F.coalesce(before, F.lit(0)).alias("before"))
    return rows.filter("due > before").select("call_id", "ord", "level")


def admitted(incoming: DataFrame, lines: DataFrame) -> DataFrame:
    """incoming (call_id, from_number, to_number, forwarded_from) against lines (line_id, guard_number, phone_number), one for each guard number: call_id, line_id, decision.

    A call to no line's guard number has ``no_line``; one from the line's own
    numbers, or forwarded by the protected one, would call itself: ``loop``.
    """
    known = lines.select("line_id", F.col("guard_number").alias("to_number"), "phone_number")
    own = (F.col("from_number") == F.col("phone_number")) | (F.col("from_number") == F.col("to_number")) | (F.col("forwarded_from") == F.col("phone_number"))
    decision = F.when(F.col("line_id").isNull(), "no_line").when(F.coalesce(own, F.lit(False)), "loop").otherwise("accept")
    return incoming.join(known, "to_number", "left").select("call_id", "line_id", decision.alias("decision"))
