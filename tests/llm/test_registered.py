"""Registered queries over the smallest tables: their SQL, or brute force at their own parameters."""

import os

import duckdb
import pytest
from test_operators import components_of, cut, sha

from larkspur.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    return duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, DATA).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_op10(spark, rows):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["text"]) for r in QUERIES["op10_radix_suffixes"](spark, DATA).collect()}
    assert got.keys() == {i for i, _ in rows}
    assert any(r[1] for r in got.values())
    for (i, t), (gone, spans, rest) in zip(rows, cut([t for _, t in rows], 400), strict=True):
        assert got[i] == (len((t or "").encode()), gone, spans, sha(rest), rest.decode("utf-8", "ignore"))


def test_op10_passages_of_words(spark, tmp_path):
    """A passage of 51 words below 400 bytes goes from clean_text; the contract's columns keep to 400 bytes."""
    import random

    from test_operators import words

    rng = random.Random(31)
    passage, short, long = words(rng, 51), words(rng, 50), words(rng, 90)
    assert len(passage) < 400 < len(long)
    own = [words(rng, 30) for _ in range(10)]
    texts = [f"{own[0]} {passage} {own[1]}", f"{own[2]}\n{passage}\té {own[3]}", f"{own[4]} {short} {own[5]}", f"{own[6]} {short} {own[7]}", f"{long} {own[8]} {passage}", f"{long} {own[9]}", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op10_radix_suffixes"](spark, str(tmp_path)).collect()}
    for i, (gone, spans, rest) in enumerate(cut(texts, 400)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["text"]) == (len((texts[i] or "").encode()), gone, spans, sha(rest), rest.decode())
        assert r["clean_text"].split() == (texts[i] or "").replace(passage, "").replace(long, "").split()


def test_op6(spark, rows):
    root, sizes = components_of([t for _, t in rows], 2, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in QUERIES["op6_chosen_path_join"](spark, DATA).collect()}
    assert got == {i: (n, rows[c][0], k == c) for k, ((i, _), c, n) in enumerate(zip(rows, root, sizes, strict=True))}


#: Names that the operators give their own columns.
CLASHING = ("cut", "k1", "k2", "n", "h", "row", "rank", "group", "salt", "length", "piece", "start", "words", "word", "phrase", "a", "l", "r", "k", "score", "best", "form", "output", "keep_id", "kept", "component_id", "n_shingles", "sequence_id", "TEXT_SHA256", "anchor", "line", "key", "Doc.Id")


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("op") and n not in ("op4_url_trees", "op5_content_addressed_warc")))
def test_columns_with_clashing_names(spark, tmp_path, name):
    """Other columns of documents stop no query and change no result, whatever they are called."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("doc_id < 60")
    docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)]).write.parquet(f"{tmp_path}/more/documents.parquet")
    docs.write.parquet(f"{tmp_path}/plain/documents.parquet")
    for part in ("more", "plain"):
        spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{tmp_path}/{part}/labels.parquet")
    more = QUERIES[name](spark, f"{tmp_path}/more")
    if name == "op12_pattern_growth":
        assert more.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and more.count()
    elif name in ("op6_chosen_path_join", "op9_golomb_exchange", "op10_radix_suffixes"):
        plain = QUERIES[name](spark, f"{tmp_path}/plain")
        rows = [sorted(str(tuple(r)) for r in df.select(*plain.columns).collect()) for df in (more, plain)]
        assert rows[0] == rows[1] and rows[0]
    else:
        assert {r["doc_id"] for r in more.select("doc_id").collect()} <= set(range(60)) and more.count() > 20


def test_op1_and_op3(spark, rows):
    """Ids of the registered queries against the tokenizers library itself."""
    import zlib

    import numpy as np
    from public_tokenizers import path
    from tokenizers import Tokenizer

    byte, word = (Tokenizer.from_file(path(name)) for name in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    for t in (byte, word):
        t.no_truncation()
        t.no_padding()
    packed = QUERIES["op1_pattern_packing"](spark, DATA).collect()
    ids = {i: np.array([*byte.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in rows}
    seen = {i: 0 for i, _ in rows}
    for r in sorted(packed, key=lambda r: (r["doc_id"], r["piece"])):
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == seen[r["doc_id"]] and r["ids_crc32"] == zlib.crc32(own.tobytes())
        seen[r["doc_id"]] += r["length"]
    assert seen == {i: len(x) for i, x in ids.items()}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op3_rank_array_bpe"](spark, DATA).collect()}
    for i, t in rows:
        found = word.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(found), sha(" ".join(map(str, found))), sha(word.decode(found, skip_special_tokens=False)))


def test_op2(spark, rows):
    texts = {i: t or "" for i, t in rows}
    down = sorted(texts, reverse=True)
    after = dict(zip(down, [*down[1:], down[0]], strict=True))
    for r in QUERIES["op2_lz_fingerprint"](spark, DATA).collect():
        own, other = texts[r["doc_id"]], texts[after[r["doc_id"]]]
        edited = own[: len(own) - len(own) // 3] + other[: len(own) // 3]
        assert r["n_chars"] == len(own) and r["edited_sha256"] == sha(edited)
        assert 0 <= r["near_edited"] <= 1 and (r["near_next"] == 1 if own == other else True)
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (r["near_edited"] == 1) or own != edited


def test_pipeline_on_an_odd_table(spark, tmp_path):
    """Nulls, very long texts, repeated and null ids, clashing columns; and an empty table."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("doc_id < 80")
    odd = [(900, None), (901, ""), (902, " " * 200_000), (903, "word " * 60_000), (904, "x" * 300_000), (None, "a text without an id"), (905, "twice"), (905, "twice")]
    more = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in odd], docs.schema)
    for part, df in (("odd", docs.unionByName(more)), ("empty", docs.limit(0))):
        df.select("*", *[F.lit(1).alias(c) for c in ("cut", "row", "kept", "k1", "length")]).write.parquet(f"{tmp_path}/{part}/documents.parquet")
        spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{tmp_path}/{part}/labels.parquet")
        out = QUERIES["pipeline"](spark, f"{tmp_path}/{part}")
        assert (out.count() == 0) == (part == "empty")
        assert {r["doc_id"] for r in out.select("doc_id").collect()} <= {*range(80), *range(900, 906), None}
