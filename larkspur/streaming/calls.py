"""The call scorer as one stateful streaming operator, keyed by call."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspur.functions.call_patterns import CALL_RULES
from larkspur.operators.calls import USER_FACTOR, line_flags, short

OUT = "call_id string, ord long, score double, level string, rules string, sequence long, alert boolean"
_STATE = "caller array<int>, user array<int>, mark string, sequence long, alerted int, last long"
_RANK = {"info": 0, "low": 1, "medium": 2, "high": 3}
_LEVELS = ("safe", "low", "medium", "high")


def _verdict(caller: set[int], user: set[int]) -> tuple[float, int, str]:
    """Score, level's rank and rules, severest first."""
    fired = []
    for i, (id_, _, severity, weight, _, _, _, _) in enumerate(CALL_RULES):
        if i in caller or i in user:
            fired.append((-_RANK[severity], -(weight if i in caller else round(weight * USER_FACTOR, 4)), i, id_))
    rest = 1.0
    for _, w, _, _ in sorted(fired, key=lambda f: f[2]):
        rest *= 1 + w
    score = round(1 - rest, 9)
    level = 3 if score >= 0.75 else 2 if score >= 0.5 else 1 if score >= 0.3 else 0
    return score, level, ",".join(f[3] for f in sorted(fired))


def score_stream(lines: DataFrame, minimum: int = 2, idle_ms: int = 3_600_000) -> DataFrame:
    """A row for each final line that changes its call's verdict, with whether it raises an alert.

    The patterns run as column expressions before the state, so the state
    holds only which rules a caller and a user have matched.  Lines of a call
    must come in order from batch to batch; within a batch they are sorted.
    Calls that are idle for ``idle_ms`` are forgotten.
    """
    names = [short(r[0]) for r in CALL_RULES]
    users = {i for i, r in enumerate(CALL_RULES) if r[6]}
    fired = F.array_compact(F.array(*[F.when(F.col(n), F.lit(i)) for i, n in enumerate(names)]))
    rows = line_flags(lines).filter("final").select("call_id", "ord", "speaker", fired.alias("fired"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        caller, user, mark, sequence, alerted, last = state.get if state.exists else ([], [], None, 0, 0, -1)
        caller, user, out = set(caller), set(user), []
        for r in pd.concat(list(batches)).sort_values("ord").itertuples():
            hits = set(map(int, r.fired))
            user |= hits
            caller |= hits if r.speaker == "caller" else hits & users
            score, level, rules = _verdict(caller, user)
            now = f"{_LEVELS[level]}|{score:.2f}|{rules}"
            if now != mark:
                mark, sequence = now, sequence + 1
                alert = level >= max(minimum, 1) and level > alerted
                alerted = max(alerted, level) if alert else alerted
                out.append((key[0], int(r.ord), score, _LEVELS[level], rules, sequence, alert))
            last = int(r.ord)
        state.update((sorted(caller), sorted(user), mark, sequence, alerted, last))
        state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return rows.groupBy("call_id").applyInPandasWithState(step, OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
