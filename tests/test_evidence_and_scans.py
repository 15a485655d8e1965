"""Quotes, summaries, as-of states, scopes, cursors and evaluation against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from larkspur.functions import call_matching
from larkspur.operators import calls, evaluation, scans, transcripts


def plain_quote(line, first, last):
    if len(line) <= 120:
        return line
    start = max(0, first - (120 - (last - first)) // 2)
    end = min(len(line), start + 120)
    if end - start < 120:
        start = max(0, end - 120)
    if start > 0 and " " in line[start:first]:
        start += line[start:first].index(" ") + 1
    if end < len(line):
        cut = line[: end + 1].rfind(" ")
        end = cut if cut > last else end
    return ("…" if start > 0 else "") + line[start:end].strip() + ("…" if end < len(line) else "")


def test_quotes_stand_around_the_match():
    rng = random.Random(1)
    for _ in range(3000):
        line = " ".join("w" * rng.randint(1, 30) for _ in range(rng.randint(1, 40)))
        first = rng.randrange(len(line))
        last = min(len(line), first + rng.randint(1, 140))
        assert call_matching.quote(line, first, last) == plain_quote(line, first, last)


def test_evidence_masks_digits_and_names_the_speaker(spark):
    rows = [
        ("c", 1, "user", "The code is 4829 1301, there is a warrant", True), ("c", 2, "caller", "x" * 130 + " there is a warrant out, badge 123456 " + "y " * 80, True), ("d", 1, "user", "my password is sunflower", True),
        ("e", 1, "caller", "Buy gift cards. Pick up two gift cards for my niece", True), (None, 1, "caller", "There is a warrant", True), ("f", 1, "caller", None, True), ("g", 1, None, "There is a warrant", True), ("h", 1, "caller", "There is a warrant", None),
    ]
    lines = spark.createDataFrame(rows, "call_id string, ord long, speaker string, text string, final boolean")
    found = {(r["call_id"], r["rule"]): r["detail"] for r in calls.evidence(lines).collect()}
    warrant = found["c", "call.government_threat"]
    assert warrant.startswith("Caller said: “…there is a warrant out, badge •••••• y") and warrant.endswith("y…”")
    assert found["d", "call.user_sharing_sensitive"] == calls.SHARED
    assert found[None, "call.government_threat"] == "Caller said: “There is a warrant”"
    assert not any(k[0] in ("f", "h") for k in found)
    assert {(r["call_id"], r["rule"]) for r in calls.signals(lines).collect()} == set(found)
    said = {r["call_id"]: r["summary"] for r in calls.summaries(calls.evidence(lines)).collect()}
    assert said["d"] == "This call looks like an attempt to get your codes or passwords: You read out a code or card number."
    assert calls.evidence(lines.limit(0)).count() == 0


def test_latest_state_at_each_row(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 30), i) for i in range(80)]
    states = [(rng.choice(["a", "b", None]), rng.randint(0, 30), rng.randint(0, 9), rng.choice(["x", "y"])) for _ in range(25)]
    got = transcripts.with_latest(spark.createDataFrame(rows, "k string, n long, i long"), spark.createDataFrame(states, "k string, n long, v long, w string"), "k", "n", ["v", "w"])
    for r in got.collect():
        before = [s for s in states if s[0] == r["k"] and s[1] <= r["n"]]
        want = max(before, key=lambda s: s[1:]) if before else (None,) * 4
        assert (r["v"], r["w"]) == want[2:]
    assert got.count() == 80


def test_scopes_unite_and_all_absorbs(spark):
    rows = [("s", [3, 1]), ("s", [1, 2, None]), ("t", [1]), ("t", None), ("u", []), ("u", []), (None, [5])]
    got = {r["k"]: (r["every"], r["accounts"]) for r in scans.merged_scopes(spark.createDataFrame(rows, "k string, accounts array<int>"), "k").collect()}
    assert got == {"s": (False, [1, 2, 3]), "t": (True, None), "u": (False, []), None: (False, [5])}


def test_cursors_advance_only_when_all_is_processed(spark):
    cursors = spark.createDataFrame([("done", 5), ("open", 5), ("idle", 5), ("behind", 50)], "account_id string, cursor long")
    fetched = spark.createDataFrame([("done", 1, 9), ("done", 2, 9), ("open", 1, 9), ("open", 2, 9), ("behind", 7, 9), ("new", 1, 3)], "account_id string, message_id long, next_cursor long")
    processed = spark.createDataFrame([("done", 1), ("done", 2), ("done", 2), ("open", 1), ("behind", 7), ("new", 1)], "account_id string, message_id long")
    got = {r["account_id"]: (r["cursor"], r["advanced"]) for r in scans.advanced_cursors(cursors, fetched, processed).collect()}
    assert got == {"done": (9, True), "open": (5, False), "idle": (5, False), "behind": (50, False), "new": (3, True)}


@pytest.mark.parametrize("decimals", [0, 2, 12])
def test_sweep(spark, decimals):
    rng = random.Random(decimals)
    rows = [(round(rng.random(), decimals), rng.random() < 0.3) for _ in range(400)] + [(None, True), (0.5, None), (1.0, True), (0.0, False)]
    frame = spark.createDataFrame(rows, "score double, positive boolean").repartition(5)
    known = [r for r in rows if None not in r]
    for r in evaluation.sweep(frame).collect():
        at = r["threshold"]
        tp, fp = (sum(p is k and s >= at for s, p in known) for k in (True, False))
        fn, tn = (sum(p is k and s < at for s, p in known) for k in (True, False))
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (tp, fp, fn, tn)
        assert r["precision"] == pytest.approx(tp / (tp + fp), abs=1e-6) and r["recall"] == pytest.approx(tp / (tp + fn), abs=1e-6)
    assert evaluation.sweep(frame).count() == len({s for s, _ in known})
    assert evaluation.sweep(frame.limit(0)).count() == 0
    got = {r["positive"]: tuple(r)[1:] for r in evaluation.bounds(frame, 0.3).collect()}
    for k in (True, False):
        own = [s for s, p in known if p is k]
        assert got[k] == (len(own), min(own), max(own), sum((s >= 0.3) is k for s in own))


def test_matching_keeps_no_state_between_rows(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "There is a warrant").when(F.col("id") % 3 == 1, "soup").alias("t"))
    got = rows.select("t", call_matching.hits(F.col("t")).alias("h")).groupBy("t").agg(F.collect_set("h").alias("h")).collect()
    assert {r["t"]: len(r["h"]) for r in got} == {"There is a warrant": 1, "soup": 1, None: 1}
