"""Exact deduplication by a Golomb-coded exchange of fingerprints.

1. Each partition hashes its normalised texts, sorts the distinct hashes and
   sends them to their owners (a hash range each) as Golomb-Rice-coded gaps.
2. An owner decodes what it got, finds the hashes that two partitions share,
   and answers each partition with a bitmap over the hashes it had sent.
3. Rows whose bit is set, or whose hash occurs twice in their own partition,
   are suspects.  Only their texts are shuffled, and compared byte for byte.

So a text that occurs once costs a few bits of network traffic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.skew import join_groups
from larkspur.llm.workspace import Scratch, broadcast_if, fresh, own

#: Hashes that one owner gets, about: bounds an owner's memory.
OWNER_ROWS = 200_000
#: Most rows of a table that is broadcast: an id and a digest of 32 bytes each.
BROADCAST_ROWS = 200_000


def rice_encode(values: np.ndarray) -> bytes:
    """Golomb-Rice code of sorted distinct uint64: count, first value, bits of the remainder, then the gaps."""
    n = len(values)
    head = np.array([n, values[0] if n else 0], "<u8").tobytes()
    if n < 2:
        return head + b"\0"
    gaps = np.diff(values)
    mean = int(values[-1] - values[0]) // (n - 1)
    low = max(0, (mean * 7 // 10).bit_length() - 1)
    quotient = (gaps >> np.uint64(low)).astype(np.int64)
    widths = quotient + 1 + low
    ends = np.cumsum(widths)
    bits = np.zeros(int(ends[-1]), np.uint8)
    # quotient ones, a zero, then the remainder
    starts = ends - widths
    runs = np.repeat(starts - np.concatenate([[0], np.cumsum(quotient)[:-1]]), quotient)
    bits[runs + np.arange(len(runs))] = 1
    at = starts + quotient + 1
    for k in range(low):
        bits[at + k] = (gaps >> np.uint64(low - 1 - k)).astype(np.uint8) & 1
    return head + bytes([low]) + np.packbits(bits).tobytes()


def rice_decode(blob: bytes) -> np.ndarray:
    """The values that ``rice_encode`` was given."""
    n, first = (int(x) for x in np.frombuffer(blob[:16], "<u8"))
    if n < 2:
        return np.array([first][:n], np.uint64)
    low = blob[16]
    bits = np.unpackbits(np.frombuffer(blob[17:], np.uint8))
    zeros = np.flatnonzero(bits == 0)
    quotient, at = np.empty(n - 1, np.uint64), np.empty(n - 1, np.int64)
    nearest = np.searchsorted(zeros, np.arange(len(bits) + 1))  # index of the first zero at or after a bit
    here = 0
    for i in range(n - 1):
        stop = int(zeros[nearest[here]])
        quotient[i], at[i] = stop - here, stop + 1
        here = stop + 1 + low
    rest = np.zeros(n - 1, np.uint64)
    for k in range(low):
        rest = (rest << np.uint64(1)) | bits[at + k].astype(np.uint64)
    gaps = (quotient << np.uint64(low)) | rest
    return np.cumsum(np.concatenate([np.array([first], np.uint64), gaps]), dtype=np.uint64)


def _send(owners: int):
    step = (1 << 64) // owners + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        src = TaskContext.get().partitionId()
        h = table["h"].to_numpy().view(np.uint64)
        kinds, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
        owner = (kinds // np.uint64(step)).astype(np.int64)
        first = np.searchsorted(owner, owner)  # where the owner's message begins
        n, k = table.num_rows, np.unique(owner)
        blobs = [rice_encode(kinds[np.searchsorted(owner, o) : np.searchsorted(owner, o, "right")]) for o in k]
        rows = pa.table({
            "doc_id": table["doc_id"], "n_chars": table["n_chars"], "sha": table["sha"], "src": np.full(n, src), "owner": owner[inverse],
            "idx": (inverse - first[inverse]).astype(np.int64), "twice": counts[inverse] > 1, "blob": pa.nulls(n, pa.binary()),
        })
        m = len(k)
        sent = pa.table({
            "doc_id": pa.nulls(m, table["doc_id"].type), "n_chars": pa.nulls(m, table["n_chars"].type), "sha": pa.nulls(m, table["sha"].type),
            "src": np.full(m, src), "owner": k, "idx": pa.nulls(m, pa.int64()), "twice": pa.nulls(m, pa.bool_()), "blob": pa.array(blobs, pa.binary()),
        }, schema=rows.schema)
        yield from rows.to_batches()
        yield from sent.to_batches()

    return run


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """Bitmaps of the hashes that more than one partition sent."""
    sent = [rice_decode(x) for x in group["blob"]]
    values, counts = np.unique(np.concatenate(sent), return_counts=True)
    shared = values[counts > 1]
    out = []
    for h in sent:
        bits = np.zeros(-(-len(h) // 64) * 64, np.uint8)
        bits[: len(h)] = np.isin(h, shared, assume_unique=True)
        out.append(np.packbits(bits, bitorder="little").view("<i8"))
    return pd.DataFrame({"src": group["src"], "owner": group["owner"], "bitmap": out})


def normalised(text: Column) -> Column:
    """The text without space, tab, line feed, vertical tab, form feed and carriage return; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised bytes are.  Of equal texts the row
    with most code points in its original text stays, then the smallest doc_id
    (a null one counts as largest).  Null and empty texts, and texts of white
    space only, are equal to one another.  Rows that repeat a doc_id are rows
    of their own; only one row is kept of rows alike in text and doc_id, or
    where all ids are null: which of them is not defined, their values being the same.
    An empty table gives an empty result; other columns are ignored.
    """
    with Scratch(docs.sparkSession) as scratch:
        norm = normalised(F.col("text"))
        slim = docs.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), norm.alias("norm")).select(
            "doc_id", "n_chars", F.unhex(F.sha2("norm", 256)).alias("sha"), F.xxhash64("norm").alias("h")
        )
        owners = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.count() // OWNER_ROWS + 1)
        told = scratch.stage(slim.mapInArrow(_send(owners), "doc_id long, n_chars long, sha binary, src long, owner long, idx long, twice boolean, blob binary"))
        rows = told.filter("blob is null").drop("blob")
        answers = (
            told.filter("blob is not null").select("src", "owner", "blob").groupBy("owner")
            .applyInPandas(_answer, "src long, owner long, bitmap array<long>")
        )
        marked = scratch.stage(
            rows.join(answers, ["src", "owner"]).select(
                "doc_id", "n_chars", "sha", (F.col("twice") | (F.expr("getbit(bitmap[int(idx div 64)], int(idx % 64))") == 1)).alias("suspect")
            )
        )
        suspects = marked.filter("suspect")
        # one record per digest: map-side combining folds a hot group before the shuffle
        ranked = suspects.groupBy("sha", "n_chars").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
        groups = scratch.stage(
            ranked.groupBy("sha").agg(F.sum("n").alias("group_size"), F.max_by("doc_id", "n_chars").alias("keep_id"), F.max("n_chars").alias("most"))
        )
        _verify(docs, groups.filter("group_size > 1").select("sha"))
        total = marked.count()
        found = join_groups(suspects, groups, ["sha"], "group_size", total)
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("most"))
        alone = marked.filter("not suspect").select("sha", "doc_id", "n_chars", "suspect", F.lit(1).cast("long").alias("group_size"), F.col("doc_id").alias("keep_id"), F.col("n_chars").alias("most"), F.lit(True).alias("kept"))
        best = _one_of_alike(found.withColumn("kept", kept)).unionByName(alone)
        return scratch.keep(scratch.stage(best.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))))


def _one_of_alike(rows: DataFrame) -> DataFrame:
    """Of the kept rows of a group that repeat one doc_id, leaves one as kept; others pass through untouched."""
    kept = rows.filter("kept").groupBy(*[c for c in rows.columns]).agg(F.count("*").alias("alike"))
    first = kept.drop("alike")
    again = kept.filter("alike > 1").withColumn("kept", F.lit(False)).select("*", F.explode(F.sequence(F.lit(2).cast("long"), F.col("alike"))).alias("_")).drop("_", "alike")
    return rows.filter("not kept").unionByName(first).unionByName(again)


def _verify(docs: DataFrame, digests: DataFrame) -> None:
    """Shuffles the suspects' texts and compares bytes: each digest must stand for one normalised text.

    Grouping by the text itself compares bytes, and folds copies before the shuffle.
    """
    digests = broadcast_if(digests, BROADCAST_ROWS)
    norm = docs.select(normalised(F.col("text")).alias("norm")).withColumn("sha", F.unhex(F.sha2("norm", 256)))
    distinct = norm.join(digests, "sha", "left_semi").groupBy("sha", "norm").count()
    clash = distinct.groupBy("sha").count().filter("count > 1").limit(1).count()
    if clash:
        raise ArithmeticError("two different texts share a SHA-256 digest")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``deduplicate`` keeps, with all their columns; one of rows alike in doc_id and text.

    Where no row that goes shares id and digest with one that stays, which is
    so unless ids repeat, only the keys of the rows that go are moved.
    """
    judged = deduplicate(docs.select("doc_id", "text"))
    i, h, d, n, r = (fresh(c, docs.columns) for c in ("id", "h", "digest", "n", "r"))
    columns = [own(docs, c) for c in docs.columns]
    marked = docs.select(*columns, F.unhex(F.sha2(normalised(docs["text"]), 256)).alias(h), F.char_length(F.coalesce(docs["text"], F.lit(""))).alias(n))
    repeats = judged.filter("not kept and doc_id <=> keep_id").limit(1).count()
    with Scratch(docs.sparkSession) as scratch:
        listed = judged.filter("kept" if repeats else "not kept").select(F.col("doc_id").alias(i), F.unhex("text_sha256").alias(d))
        listed = scratch.keep(scratch.stage(listed))
    found = marked.join(broadcast_if(listed, BROADCAST_ROWS), marked["doc_id"].eqNullSafe(listed[i]) & (marked[h] == listed[d]), "left_semi" if repeats else "left_anti")
    if repeats:
        rank = Window.partitionBy("doc_id", h).orderBy(F.desc(n))
        found = found.withColumn(r, F.row_number().over(rank)).filter(F.col(r) == 1)
    return found.select(*(own(found, c) for c in docs.columns))
