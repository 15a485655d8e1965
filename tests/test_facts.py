"""Facts of keys meet their rows without moving the rows by key, however common a key is."""

from pyspark.sql import functions as F

from larkspur.functions import lexicon
from larkspur.operators import facts, mail


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _tables(spark):
    key = F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string")))
    rows = spark.range(3000).select("id", key.alias("key"))
    known = facts.distinct(rows.filter("key is not null and key <> 'k7'"), "key")
    return rows, facts.staged(known.withColumn("size", F.length("key")))


def test_few_facts_are_broadcast_and_many_meet_spread_rows(spark):
    rows, known = _tables(spark)
    want = sorted((r["id"], len(r["key"]) if r["key"] and r["key"] != "k7" else None) for r in rows.collect())
    few, many = facts.with_facts(rows, known, "key", "id"), facts.with_facts(rows, known, "key", "id", most=5, hot=3)
    for out in (few, many):
        assert sorted((r["id"], r["size"]) for r in out.collect()) == want
        assert set(out.columns) == {"id", "key", "size"}
    assert "Exchange hashpartitioning" not in _plan(few)
    assert "_spread" in _plan(many)


def test_messages_are_not_moved_by_domain_or_host(spark):
    rows = spark.createDataFrame([("m1", {"name": "PayPal", "address": "a@x.example"}, [{"href": "http://paypal.evil.example/pay", "anchor": "Pay"}])], "message_id string, `from` struct<name:string,address:string>, links array<struct<href:string,anchor:string>>")
    given = spark.createDataFrame([], mail.SCHEMA).unionByName(rows, allowMissingColumns=True)
    out = mail.context(given).select("message_id", "registrable", "mentioned", "l_stray", "l_alike")
    plan = _plan(out)
    assert not any(f"hashpartitioning({c}#" in plan for c in ("from_domain", "odd_reply", "host"))
    assert [tuple(r) for r in out.collect()] == [("m1", "x.example", ["paypal"], 0, 1)]


def test_a_text_is_searched_once_for_each_batch(spark):
    rows = spark.range(0, 8, 1, 1).select("id", F.when(F.col("id") % 4 == 0, None).when(F.col("id") % 4 == 1, F.lit("")).otherwise("urgent").alias("t"))
    assert [r[0] for r in rows.select(lexicon.matches(F.col("t"))).collect()] == [{}, {}, {"urgency": ["urgent"]}, {"urgency": ["urgent"]}] * 2
