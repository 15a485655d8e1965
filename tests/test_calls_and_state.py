"""Call rules, streaming against batch, debounce, state tables and mailbox scans."""

import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.functions import call_matching
from larkspur.functions.call_patterns import BULK_GIFT_CARDS, CALL_RULES, ERRAND, PROTECTIVE_ADVICE
from larkspur.operators import calls, debounce, state, transcripts
from larkspur.plans import synthetic as syn
from larkspur.sources import mailboxes
from larkspur.streaming.calls import score_stream
from larkspur.streaming.debounce import debounce_stream

DATA = "/root/testdata/sf0.001"


def fired(spark, lines):
    frame = spark.createDataFrame([("c", i, s, t, True) for i, (s, t) in enumerate(lines)], "call_id string, ord long, speaker string, text string, final boolean")
    return {r["rule"] for r in calls.signals(frame).collect()}


@pytest.mark.parametrize(
    ("line", "rules"),
    [
        ("Pick up a Target gift card for your sister's birthday on your way home", {"call.gift_card_errand"}),
        ("Go buy gift cards at the store and read me the numbers", {"call.gift_cards"}),
        ("Get gift cards for the teachers and bring them home", None),
        ("We will never ask you to share a code or buy gift cards", set()),
        ("Soup is ready", set()),
    ],
)
def test_gift_card_tiers(spark, line, rules):
    got = fired(spark, [("caller", line)])
    assert got == rules if rules is not None else "call.gift_cards" not in got


def brute_hits(line):
    """Every pattern tried."""
    import regex

    def found(patterns, text=line):
        return any(regex.search(p, text, regex.ASCII | regex.IGNORECASE) for p in patterns)

    out = sum(1 << i for i, r in enumerate(CALL_RULES) if found(r[7])) | found(PROTECTIVE_ADVICE) << call_matching.PROTECTIVE_BIT
    return out | any(found(BULK_GIFT_CARDS, s) and not found(ERRAND, s) for s in line.split("."))


def test_the_automaton_loses_no_match():
    """Strings made from the patterns themselves, alone and inside other words, in either case."""
    import random
    import re
    import warnings

    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    rng, lines = random.Random(2), []
    for pattern in [*PROTECTIVE_ADVICE, *BULK_GIFT_CARDS, *(p for r in CALL_RULES for p in r[7])]:
        try:
            made = re.compile(pattern, re.ASCII | re.IGNORECASE)
        except re.error:
            continue  # look-behinds of several lengths

        @settings(max_examples=4, database=None, derandomize=True, deadline=None, suppress_health_check=list(HealthCheck))
        @given(st.from_regex(made))
        def collect(text):
            lines.append(text)

        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            collect()
    lines += [f"so {x.upper()} and" for x in rng.sample(lines, 100)] + [f"{a} {b}" for a, b in zip(rng.sample(lines, 60), syn.LINES * 5, strict=True)] + list(syn.LINES)
    hits = call_matching.matcher().hits
    assert [x for x in lines if hits(x) != brute_hits(x)] == []
    assert sum(map(bool, map(hits, lines))) > 150


def test_user_lines_weigh_half_and_callers_win(spark):
    frame = spark.createDataFrame([("c", 1, "user", "There is a warrant", True), ("d", 1, "user", "There is a warrant", True), ("d", 2, "caller", "There is a warrant", True)], "call_id string, ord long, speaker string, text string, final boolean")
    got = {(r["call_id"], r["weight"], r["speaker"]) for r in calls.signals(frame).collect()}
    assert got == {("c", 0.325, "user"), ("d", 0.65, "caller")}


def run_stream(spark, frame, schema, tmp_path, query, parts=4):
    source = str(tmp_path / "in")
    for i in range(parts):
        frame.filter(F.pmod("part", F.lit(parts)) == i).drop("part").coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)  # files are taken by age
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = query(stream).writeStream.format("memory").queryName("out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        wanted, end = frame.count(), time.time() + 60  # with processing-time timers there is always another batch
        while sum(p["numInputRows"] for p in q.recentProgress) < wanted and time.time() < end:
            time.sleep(0.3)
        time.sleep(4)
    finally:
        q.stop()
    return spark.table("out")


def test_streamed_verdicts_are_the_batch_verdicts(spark, tmp_path):
    lines = syn.lines(spark, DATA).filter("cast(substr(call_id, 2) as int) < 25")
    batch = {tuple(r) for r in calls.running_verdicts(lines).filter("changed").select("call_id", "ord", F.round("score", 6), "level", "rules", "sequence").collect()}
    part = F.ntile(3).over(Window.orderBy("ord")) - 1
    got = run_stream(spark, lines.withColumn("part", part), lines.schema, tmp_path, score_stream, 3)
    assert {tuple(r) for r in got.select("call_id", "ord", F.round("score", 6), "level", "rules", "sequence").collect()} == batch
    rises = {tuple(r) for r in calls.alerts(calls.running_verdicts(lines)).select("call_id", "ord").collect()}
    assert {tuple(r) for r in got.filter("alert").select("call_id", "ord").collect()} == rises


def naive_sends(times, wait):
    out, last, waiting = [], None, None
    for at in sorted(times):
        if waiting is not None and last + wait <= at:
            last = last + wait
            out.append((last, waiting))
            waiting = None
        if waiting is not None or (last is not None and at - last < wait):
            waiting = at
        else:
            last = at
            out.append((at, at))
    return out + ([(last + wait, waiting)] if waiting is not None else [])


def test_debounce(spark, tmp_path):
    times = {"a": [0, 5, 9_000, 10_000, 25_000, 26_000], "b": [1], "c": list(range(0, 60_000, 3_000))}
    times = {k: [t + 1_000_000 for t in ts] for k, ts in times.items()}  # a watermark starts at 0
    frame = spark.createDataFrame([(k, t) for k, ts in times.items() for t in ts], "account_key string, at_ms long")
    got = {(r["account_key"], r["sent_at"], r["request_at"]) for r in debounce.sends(frame, 10_000).collect()}
    want = {(k, *s) for k, ts in times.items() for s in naive_sends(ts, 10_000)}
    assert got == want
    stream = frame.union(spark.createDataFrame([("z", 1_500_000), ("y", 1_900_000)], frame.schema)).select("account_key", F.timestamp_millis("at_ms").alias("at"))
    stream = stream.withColumn("part", F.when(F.col("account_key") == "z", 1).when(F.col("account_key") == "y", 2).otherwise(0))
    spark.sql("drop view if exists out")
    seen = run_stream(spark, stream, "account_key string, at timestamp", tmp_path, lambda s: debounce_stream(s, 10_000), 3)
    assert {tuple(r) for r in seen.filter("account_key < 'y'").select("account_key", "sent_at", "request_at").collect()} == want


def test_upsert_and_takeover(spark):
    old = spark.createDataFrame([(1, "x", 10, True), (2, "y", 20, False)], "id int, token string, created int, alerted boolean")
    new = spark.createDataFrame([(2, None, 99, True), (3, "z", 30, False)], "id int, token string, created int, alerted boolean")
    got = state.upsert(old, new, ["id"], keep_old=("created",), sticky=("alerted",), fill=("token",))
    assert sorted(map(tuple, got.collect())) == [(1, "x", 10, True), (2, "y", 20, True), (3, "z", 30, False)]
    lines = spark.createDataFrame([("l1", "d1", "+1", 5), ("l2", "d2", "+2", 6)], "line_id string, device_id string, guard_number string, created_at int")
    claims = spark.createDataFrame([("l2", "d2", "+1", 9)], lines.schema)
    assert [tuple(r) for r in state.take_over(lines, claims).collect()] == [("l2", "d2", "+1", 6)]


def test_titles(spark):
    row = spark.createDataFrame([(["one", "two", "x" * 200, "three"],)], "t array<string>").select(state.joined_titles(F.col("t"), 20)).first()
    assert row[0] == "one · two"


def test_transcripts(spark):
    seg = spark.createDataFrame([("c", "a", 1, "hel", "user", False), ("c", "b", 2, "hi", "caller", True), ("c", "a", 3, "hello", "user", True), ("c", "a", 4, "hell", "user", False)], "call_id string, id string, arrival long, text string, speaker string, final boolean")
    assert sorted((r["ord"], r["text"], r["final"]) for r in transcripts.upsert_segments(seg).collect()) == [(1, "hello", True), (2, "hi", True)]


def test_mailbox_scans(spark):
    hist = spark.createDataFrame([("a", i, f"m{i}", ["INBOX"] if i % 5 else ["INBOX", "DRAFT"]) for i in range(1, 30)], "account_id string, record_id long, message_id string, labels array<string>")
    got = mailboxes.history_scan(hist, 3, cap=10).orderBy("record_id").collect()
    assert len(got) == 10 and got[0]["record_id"] == 4 and {r["next_cursor"] for r in got} == {got[-1]["record_id"]}
    body = spark.createDataFrame([('{"message": {"data": "eyJlbWFpbEFkZHJlc3MiOiAiYUBiLmMiLCAiaGlzdG9yeUlkIjogIjEyIn0="}}',), ("junk",)], "body string")
    assert [(r["email"], r["history_id"]) for r in mailboxes.pubsub(body).collect()] == [("a@b.c", 12), (None, None)]
    talk = spark.createDataFrame([("c", 1, "caller", "one two three four", 100), ("c", 2, "user", "hi", 50)], "call_id string, ord long, speaker string, text string, pause_ms long")
    assert sorted((r["at_ms"], r["text"], r["final"]) for r in mailboxes.scripted(talk).collect()) == [(100, "one two", False), (500, "one two three four", True), (550, "hi", True)]


def test_late_partials_go_and_a_final_ends_the_id(spark):
    events = [(1, "hel", False, 1), (2, "hello", False, 3), (3, "he", False, 2), (4, " hello you ", True, 2), (5, "so", False, None), (6, " ", True, 9), (7, None, True, 9)]
    frame = spark.createDataFrame([("c", "caller", *e) for e in events], "call_id string, speaker string, arrival int, text string, final boolean, sequence int")
    got = [(r["arrival"], r["id"], r["text"]) for r in transcripts.utterances(frame).orderBy("arrival").collect()]
    assert got == [(1, "caller-tw-1", "hel"), (2, "caller-tw-1", "hello"), (4, "caller-tw-1", "hello you"), (5, "caller-tw-2", "so")]


def test_three_failures_in_a_row_end_the_models_use(spark):
    outcomes = ["failed", "failed", "answered", "failed", "skipped", None, "failed", "failed", "answered", "failed"]
    frame = spark.createDataFrame([("s", i, o) for i, o in enumerate(outcomes)], "scan string, at int, outcome string")
    got = [r["allowed"] for r in state.breaker(frame, "scan", "at").orderBy("at").collect()]
    assert got == [True] * 8 + [False] * 2


def test_calls_from_own_numbers_are_loops(spark):
    lines = spark.createDataFrame([("l", "g", "p")], "line_id string, guard_number string, phone_number string")
    rows = [("a", "p", "g", None), ("b", "g", "g", None), ("c", "x", "g", "p"), ("d", "x", "g", None), ("e", "x", "other", None), ("f", None, None, None), ("h", None, "g", None)]
    frame = spark.createDataFrame(rows, "call_id string, from_number string, to_number string, forwarded_from string")
    got = {r["call_id"]: r["decision"] for r in calls.admitted(frame, lines).collect()}
    assert got == {"a": "loop", "b": "loop", "c": "loop", "d": "accept", "e": "no_line", "f": "no_line", "h": "accept"}


def test_old_live_calls_stand_before_newer_stored_ones(spark):
    kind = "call_id string, started_at int, status string"
    active = spark.createDataFrame([("live", 1, "live"), ("younger", 3, "live")], kind)
    stored = spark.createDataFrame([("a", 4, "x"), ("b", 5, "x"), ("a", 2, "x"), ("live", 1, "x"), ("live", 9, "x")], kind)
    for most, want in ((2, ["younger", "live"]), (3, ["younger", "live", "b"]), (9, ["younger", "live", "b", "a"])):
        got = [tuple(r) for r in state.active_then_stored(active, stored, most).collect()]
        assert [r[0] for r in got] == want
    assert got[3] == ("a", 4, "x") and got[1] == ("live", 1, "live")


def test_durations(spark):
    rows = [(5000, 1000, "completed"), (1000, None, "completed"), (1000, None, "in_progress"), (1000, 2499, "failed"), (1000, 2500, None), (1000, None, None), (None, 5, "failed"), (9000, None, "ringing")]
    frame = spark.createDataFrame(rows, "a long, b long, status string")
    got = [r[0] for r in frame.select(state.duration_seconds(F.col("a"), F.col("b"), F.lit(7000), F.col("status"))).collect()]
    assert got == [0, None, 6, 1, 2, 6, None, 0]
