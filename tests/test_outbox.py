"""Batches written twice, out of a stream and by hand."""

import random

from pyspark.sql import functions as F

from larkspur.operators import state
from larkspur.streaming.outbox import UpsertLog

KIND = "k string, n long, made int, alerted boolean, token string, note string"
RULES = {"keep_old": ("made",), "sticky": ("alerted",), "fill": ("token",)}


def events(n):
    rng = random.Random(n)
    return [(rng.choice(["a", "b", "c", None]), i, rng.choice([None, i]), rng.choice([None, False, False, True]), rng.choice([None, f"t{i}"]), rng.choice([None, f"x{i}"])) for i in range(n)]


def by_hand(rows):
    out = {}
    for k, n, made, alerted, token, note in sorted(rows, key=lambda r: r[1]):
        old = out.get(k, (None,) * 5)
        out[k] = (n, made if old[1] is None else old[1], bool(old[2]) or bool(alerted), token if token is not None else old[3], note)
    return out


def table_of(df):
    return {r["k"]: tuple(r[c] for c in ("n", "made", "alerted", "token", "note")) for r in df.collect()}


def test_a_fold_is_the_upserts_in_order(spark):
    rows = events(60)
    assert table_of(state.folded(spark.createDataFrame(rows, KIND).repartition(4), ["k"], ["n"], **RULES)) == by_hand(rows)


def test_batches_written_again_change_nothing(spark, tmp_path):
    rows = events(80)
    log = UpsertLog(f"{tmp_path}/table", ["k"], "n", **RULES)
    assert log.batches(spark) == []
    parts = [spark.createDataFrame(rows[i : i + 20], KIND) for i in range(0, 80, 20)]
    for b, part in enumerate(parts):
        log.write(part, b)
    want = by_hand(rows)
    assert table_of(log.current(spark)) == want
    log.write(parts[2], 2)
    log.write(parts[0].repartition(3), 0)
    assert table_of(log.current(spark)) == want
    log.compact(spark, 2)
    assert log.batches(spark) == [2, 3] and table_of(log.current(spark)) == want
    log.compact(spark, 2)
    log.write(parts[3], 3)
    assert table_of(log.current(spark)) == want
    log.write(parts[0], 0)  # one that the fold has already
    assert table_of(log.current(spark)) == want


def test_a_stream_that_is_replayed(spark, tmp_path):
    rows = events(60)
    for i in range(0, 60, 20):
        spark.createDataFrame(rows[i : i + 20], KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    log = UpsertLog(f"{tmp_path}/table", ["k"], "n", **RULES)
    for run in (1, 2):  # the second starts from nothing and writes the same batches again
        stream = spark.readStream.schema(KIND).parquet(f"{tmp_path}/in")
        query = stream.writeStream.foreachBatch(log.write).option("checkpointLocation", f"{tmp_path}/cp{run}").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        assert table_of(log.current(spark)) == by_hand(rows)
    assert log.current(spark).filter(F.col("k").isNull()).count() == 1
