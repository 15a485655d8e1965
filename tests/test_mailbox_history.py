"""The mailbox source: caps, resumption, failures and stale cursors."""

import json

import pytest

from larkspur.sources.mailbox_history import MailboxHistory


def put(folder, account, records):
    """records: id -> message ids, all in the inbox unless their name says otherwise."""
    labels = lambda m: ["INBOX", m.split("-")[0].upper()] if "-" in m else ["INBOX"]
    lines = [json.dumps({"id": i, "messages": [{"id": m, "labels": labels(m)} for m in ms]}) for i, ms in sorted(records.items())]
    (folder / f"{account}.jsonl").write_text("\n".join(lines) + "\n")


@pytest.fixture
def folder(spark, tmp_path):
    spark.dataSource.register(MailboxHistory)
    (tmp_path / "in").mkdir()
    return tmp_path / "in"


A = {i: [f"a{i}", f"a{i}x", f"a{i - 1}"] for i in range(1, 9)}
B = {3: ["b3"], 5: ["draft-b", "sent-b"], 9: ["b9"]}


def test_batch_scan(spark, folder):
    put(folder, "a@x.org", A)
    put(folder, "b", B)
    put(folder, "empty", {})
    read = lambda **o: sorted(tuple(r) for r in spark.read.format("mailbox_history").option("path", str(folder)).options(**o).load().collect())
    got = read(cap=5)
    assert [r[2] for r in got if r[0] == "a@x.org"] == ["a0", "a1", "a1x", "a2", "a2x"] and {r[3] for r in got if r[0] == "a@x.org"} == {2}
    assert [(r[1], r[2], r[3]) for r in got if r[0] == "b"] == [(3, "b3", 9), (9, "b9", 9)]
    assert [r[2] for r in read(cap=5, cursors='{"a@x.org": 7, "b": 9}')] == ["a7", "a8", "a8x"]
    put(folder, "b", {k: v for k, v in B.items() if k > 5})
    assert [(r[2], r[4]) for r in read(cursors='{"a@x.org": 8, "b": 4}')] == [("b9", True)]
    assert [(r[2], r[4]) for r in read(cursors='{"a@x.org": 8, "b": 8}')] == [("b9", False)]


def run(spark, folder, sink):
    stream = spark.readStream.format("mailbox_history").option("path", str(folder)).option("cap", 4).load()
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(folder.parent / "cp")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_stop_and_resume_loses_and_repeats_nothing(spark, folder):
    put(folder, "a", A)
    put(folder, "b", {3: ["b3"]})
    seen: dict[int, list] = {}

    def keep(df, batch):
        seen[batch] = sorted((r["account_id"], r["message_id"], r["cursor_was_reset"]) for r in df.collect())

    def fail_at_second(df, batch):
        if batch == 1:
            raise RuntimeError("the processing of this batch fails")
        keep(df, batch)

    with pytest.raises(Exception, match="fails"):
        run(spark, folder, fail_at_second)
    assert list(seen) == [0] and [m for a, m, _ in seen[0] if a == "a"] == ["a0", "a1", "a1x", "a2", "a2x"]
    run(spark, folder, keep)
    put(folder, "a", A | {9: ["a9"]})
    put(folder, "c", {1: ["c1"]})
    run(spark, folder, keep)
    run(spark, folder, keep)
    every = [r for rows in seen.values() for r in rows]
    pairs = {(a, m) for a, m, _ in every}
    assert pairs == {("a", m) for ms in (A | {9: ["a9"]}).values() for m in ms} | {("b", "b3"), ("c", "c1")}
    assert not any(reset for *_, reset in every)
    put(folder, "b", {7: ["b7"], 8: ["b8"]})  # what came between 3 and 7 is gone
    run(spark, folder, keep)
    run(spark, folder, keep)
    assert [r for rows in seen.values() for r in rows if r not in every] == [("b", "b7", True), ("b", "b8", True)]
    # a message shows again only where a later record names it again after a cursor
    again = [(a, m) for a, m, _ in every]
    assert all(again.count(p) <= 2 and (again.count(p) == 1 or p[0] == "a") for p in again)
