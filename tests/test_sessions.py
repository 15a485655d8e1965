"""Calls as keyed state on a stream, against the batch that has SQL."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.operators.sessions import session_log
from larkspur.plans import synthetic as syn
from larkspur.streaming.sessions import PROVIDER, session_stream

DATA = "/root/testdata/sf0.001"
COLUMNS = ["call_id", "n", "kind", "id", "status", "score", "level", "rules", "sequence"]
KIND = "call_id string, n long, at timestamp, kind string, speaker string, text string, final boolean, sequence long, status string, score double"


@pytest.fixture(scope="module")
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    yield spark
    spark.conf.set(name, before)


def drain(spark, folder, name, **options):
    """Runs the stream over what lies in the folder, and ends; its place and state stay for the next run."""
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = session_stream(stream, **options).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp")
    query = out.outputMode("append").trigger(availableNow=True).queryName(name).start()
    assert query.awaitTermination(240)


def rows(df):
    return {tuple(r) for r in df.withColumn("score", F.round("score", 6)).select(*COLUMNS).collect()}


def test_stream_is_the_batch_across_restarts(rocks, tmp_path):
    events = syn.session_events(rocks, DATA).select(*[c.split()[0] for c in KIND.split(", ")]).filter("cast(substr(call_id, 2) as int) < 6")
    events = events.cache()
    parts = events.withColumn("part", F.ntile(3).over(Window.orderBy("n"))).cache()
    options = {"window": 4, "retain_ms": 60_000}
    for k in (1, 2, 3):  # a run for each part: the query stops in the middle of calls
        parts.filter(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        drain(rocks, tmp_path, f"part{k}", **options)
    got = rows(rocks.read.parquet(f"{tmp_path}/out").filter("kind <> 'evicted'"))
    want = rows(session_log(events, **options))
    assert got == want
    assert {"created", "segment", "verdict", "alert", "status"} <= {r[2] for r in want}


def call(events):
    """(n, second, kind, value) as event rows of one call."""
    out = []
    for n, second, kind, value in events:
        text = value if kind == "segment" else None
        out.append(("c", n, second, kind, "caller" if text else None, text, bool(text), None, value if kind == "status" else None, value if kind == "verdict" else None))
    return out


LIFE = call([
    (1, 1, "segment", "There is a warrant for your arrest"), (2, 2, "created", None), (3, 3, "created", None), (4, 4, "status", "in_progress"), (5, 5, "status", "in_progress"),
    (6, 6, "segment", "Please stay on the line"), (7, 7, "status", "completed"), (8, 8, "status", "failed"), (9, 9, "segment", "Buy gift cards and read me the numbers"),
    (10, 20, "verdict", 0.95), (11, 60, "verdict", 0.99),
])


def as_events(spark, data):
    return spark.createDataFrame(data, KIND.replace("at timestamp", "at long")).withColumn("at", F.timestamp_seconds(F.col("at") + 1_700_000_000))


def test_life_cycle(spark):
    got = [tuple(r) for r in session_log(as_events(spark, LIFE)).orderBy("n", "kind").select("n", "kind", "status", "level", "sequence").collect()]
    assert got == [
        (2, "created", "ringing", None, None), (4, "status", "in_progress", None, None), (6, "alert", None, "medium", 1), (6, "segment", None, None, None), (6, "verdict", None, "medium", 1),
        (7, "ended", "completed", None, None), (10, "verdict", None, "high", 2),
    ]


def test_odd_events(spark):
    odd = [("c", 1, 1, "created", *[None] * 6), ("c", 2, 2, "segment", None, "x", True, None, None, None), ("c", 3, 3, "segment", "user", None, True, None, None, None), ("c", 4, 4, None, *[None] * 6)]
    odd += [("c", 5, 5, "verdict", *[None] * 6), ("c", 6, 6, "status", *[None] * 6), ("c", 7, 7, "other", *[None] * 6), (None, 1, 1, "created", *[None] * 6), ("d", 1, 1, "status", None, None, None, None, "completed", None)]
    assert sorted(str(r["call_id"]) + r["kind"] for r in session_log(as_events(spark, odd)).collect()) == ["Nonecreated", "ccreated"]
    assert session_log(as_events(spark, LIFE).limit(0)).count() == 0


def test_a_call_leaves_the_state_after_its_retention(rocks, tmp_path):
    later = [("z", 1, 30, "created", *[None] * 6)], [("z", 2, 200, "status", None, None, None, None, "connecting", None)], [("z", 3, 300, "status", None, None, None, None, "ringing", None)]
    states = []
    for k, part in enumerate((LIFE[:9], *later)):
        as_events(rocks, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        drain(rocks, tmp_path, f"life{k}", retain_ms=0, late="0 seconds")
        read = {}
        for kind in ("session", "matches"):
            state = rocks.read.format("statestore").option("path", f"{tmp_path}/cp").option("stateVarName", kind).load()
            read[kind] = sorted({r[0] for r in state.select("key.call_id").collect()})
        states.append(read)
    assert states[0] == {"session": ["c"], "matches": ["c"]}
    assert states[-1] == {"session": ["z"], "matches": []}
    out = rocks.read.parquet(f"{tmp_path}/out")
    assert [r["call_id"] for r in out.filter("kind = 'evicted'").collect()] == ["c"]
    assert rows(out.filter("call_id = 'c' and kind <> 'evicted'")) == rows(session_log(as_events(rocks, LIFE[:9])))
