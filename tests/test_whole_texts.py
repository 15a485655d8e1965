"""Queries over documents whose features lie past the cuts that they once had."""

from larkspur.plans import queries


def documents(spark, path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_caps_ratio_reads_whole_texts(spark, tmp_path):
    at = documents(spark, tmp_path, ["a" * 80 + "B" * 300, "A" * 80 + "b" * 300, "x" * 90 + "!!", "ÄÖÜÄÖÜÄÖÜÄ", None])
    got = [tuple(r)[1:] for r in queries.caps_ratio(spark, at).orderBy("doc_id").collect()]
    assert got == [(380, 300, True), (380, 80, False), (90, 0, True), (0, 0, True), (0, 0, False)]


def test_phone_probe_finds_numbers_without_country_code(spark, tmp_path):
    at = documents(spark, tmp_path, ["call 555-123-4567 now", "+1 (555) 123-4567", "x5551234567y", "12345678901234", "", None])
    got = {r["doc_id"]: r["phone"] for r in queries.phone_probe(spark, at).collect()}
    assert got == {0: "555-123-4567", 1: "+1 (555) 123-4567", 2: "5551234567"}


def labelled(spark, path):
    """Bad documents whose only number is past, across or before the 30 000th character, or nowhere, and a good one with a number far behind."""
    texts = ["x" * 40_000 + " 555-123-4567", "x" * 29_995 + " 555-123-4567", "call 555-123-4567", "x" * 40_000, "x" * 300_000 + " 555-123-4567 y"]
    spark.createDataFrame([(i, int(i == 4), 0) for i in range(5)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return documents(spark, path, texts)


def test_eval_confusion_reads_whole_texts(spark, tmp_path):
    got = sorted(tuple(r) for r in queries.eval_confusion(spark, labelled(spark, tmp_path)).collect())
    assert got == [(False, 1, 0.4, 0.4, 0), (True, 4, 0.0, 0.4, 3)]


def test_eval_sweep_reads_whole_texts(spark, tmp_path):
    got = sorted(tuple(r)[:7] for r in queries.eval_sweep(spark, labelled(spark, tmp_path)).collect())
    assert got == [(0.0, 1, 0, 4, 1, 0, 0), (0.4, 3, 1, 3, 1, 1, 0)]
