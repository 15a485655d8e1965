"""Quality classifier by importance resampling.

Two generative models of hashed n-grams are counted: one for the raw corpus,
over every document, one for the target, over labelled good documents.  A
document's importance weight is the product over its n-grams of the ratio of
the models.  Ratios of both signs count, the log of each shrunk by how surely
it differs from 0, so weak evidence adds up over a document and chance does
not.  Documents are then resampled without replacement by Gumbel top-k over the
log weights, each held against the limit of its language.

The limits are set on labelled documents that were held out.  ``k`` is a parameter;
where it is not given, as many documents are drawn as have a weight that good
documents of their language have.  At the temperature 1 the draw is that of
importance resampling itself: a document's chance is in proportion to its
weight.  Gumbel noise is rarely below -1.5, so it hardly drops a document that
is well above the limit; a lower temperature brings the draw nearer to a threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.arrow import slices, utf8
from larkspur.llm.bytehash import U64, mix, prefix, spans
from larkspur.llm.workspace import Scratch, fresh, own

#: log2 of the number of buckets of hashed n-grams.
BITS = 20
BLOCK = 1 << 12
#: Bytes of the word beginnings that are n-grams of their own, for words of two bytes more.
STEM = 5
#: Labelled documents in the fit, three of four, and the held-out rest: those with the least hash.
SAMPLE = 40_000
#: Pseudo-count of each bucket, in documents.
PRIOR = 0.3
#: The log of a ratio counts z**4 / (z**4 + DOUBT**2), where its count is z standard deviations off.
DOUBT = 12.0
#: No document of a log weight above -LEAST is under a limit.
LEAST = 0.5
#: Held-out good and bad documents from which on a language has a limit of its own.
OWN = 20
#: The limit where nothing is to be rejected.
NONE = -1e9
#: What it costs to reject a share of the good documents, against keeping the same share of the bad.
COST = 8.0
#: What log weights are divided by before noise is added.
TEMPERATURE = 1.0

_KIND = np.full(256, 1, np.int8)  # 0 white space, 1 word, 2 other
_KIND[[0x20, 9, 10, 11, 12, 13]] = 0
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and c != 95]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def grams(text: bytes) -> np.ndarray:
    """Distinct buckets of a text: its words and marks, their bigrams, the beginnings of long words, and whether many tokens repeat the one before."""
    if not text:
        return np.zeros(0, np.int64)
    codes = np.frombuffer(text, np.uint8)
    kind = np.concatenate([[0], _KIND[codes], [0]])
    start = np.flatnonzero((kind[1:-1] == 2) | ((kind[1:-1] == 1) & (kind[:-2] != 1)))
    end = np.flatnonzero((kind[1:-1] == 2) | ((kind[1:-1] == 1) & (kind[2:] != 1))) + 1
    pre = prefix(_LOWER[codes])
    h = spans(pre, start, end)
    pairs = mix(h[:-1] * U64(3) + h[1:])
    long = end - start >= STEM + 2
    stems = mix(spans(pre, start[long], start[long] + STEM) ^ U64(STEM))
    repeats = int((h[1:] == h[:-1]).sum()) * 8 // max(1, len(h))
    marks = mix(np.arange(1, repeats + 1, dtype=U64))
    return np.unique(np.concatenate([h, pairs, stems, marks]) >> U64(64 - BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per bucket in a partition, raw and target, as blocks of counts; block -1: numbers of documents."""
    raw, target, docs = np.zeros(1 << BITS, np.uint32), np.zeros(1 << BITS, np.uint32), np.zeros(2, np.uint32)
    for batch in slices(batches):
        for text, fit in zip(utf8(batch["text"]), batch["fit"].to_pylist(), strict=True):
            g = grams(text)
            raw[g] += 1
            docs[0] += 1
            if fit == 1:
                target[g] += 1
                docs[1] += 1
    blocks = [(i // BLOCK, raw[i : i + BLOCK], target[i : i + BLOCK]) for i in range(0, len(raw), BLOCK) if raw[i : i + BLOCK].any()]
    blocks.append((-1, docs[:1], docs[1:]))
    yield pa.RecordBatch.from_arrays(
        [pa.array([b[0] for b in blocks], pa.int32()), *(pa.array([b[k].astype("<u8").tobytes() for b in blocks], pa.binary()) for k in (1, 2))], ["block", "raw", "target"]
    )


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each block's counts, one block held at a time per key."""
    total: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for block, raw, target in zip(batch["block"].to_pylist(), batch["raw"].to_pylist(), batch["target"].to_pylist(), strict=True):
            counts = [np.frombuffer(raw, "<u8"), np.frombuffer(target, "<u8")]
            total[block] = counts if block not in total else [a + b for a, b in zip(total[block], counts, strict=True)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), *(pa.array([v[k].tobytes() for v in total.values()], pa.binary()) for k in (0, 1))], ["block", "raw", "target"]
    )


_BLOCKS = "block int, raw binary, target binary"


def sample_labels(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """A bounded sample (_id, fit): 1 good and in the fit, 2 good and held out, 3 bad and held out."""
    one = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("x"))
    h = F.xxhash64("doc_id")
    good = (F.col("q") == 1) & (F.col("x") == 0)
    chosen = one.select(F.col("doc_id").alias("_id"), F.when(good & (F.pmod(h, F.lit(4)) < 3), 1).when(good, 2).otherwise(3).alias("fit"), F.pmod(h, F.lit(1 << 40)).alias("o"))
    return chosen.orderBy("o", "_id").limit(sample).select("_id", "fit")


def ratios(docs: DataFrame, chosen: DataFrame) -> np.ndarray:
    """Log ratio of the target model to the raw model by bucket, near 0 where the two do not differ significantly."""
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"), "left").select("text", "fit")
    partial = rows.mapInArrow(_count, _BLOCKS)
    raw, target, n = np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(2)
    for r in partial.repartition("block").mapInArrow(_add, _BLOCKS).collect():  # 2**BITS numbers, whatever the input
        a, b = np.frombuffer(r["raw"], "<u8"), np.frombuffer(r["target"], "<u8")
        if r["block"] < 0:
            n += [a[0], b[0]]
        else:
            raw[r["block"] * BLOCK :][:BLOCK] += a
            target[r["block"] * BLOCK :][:BLOCK] += b
    expected = raw * (n[1] / max(n[0], 1))
    z4 = ((expected - target) ** 2 / (expected + 1)) ** 2
    return (np.log((target + PRIOR) / (expected + PRIOR)) * z4 / (z4 + DOUBT**2)).astype(np.float32)


def _gumbel(doc_id: np.ndarray, text: list[bytes]) -> np.ndarray:
    """Standard Gumbel noise that is a function of a row's id and text."""
    ends = np.array([len(t) for t in text], U64)
    u = mix(doc_id.view(U64) ^ mix(ends))
    return -np.log(-np.log((u >> U64(11)).astype(float) / (1 << 53) + 2.0**-54))


def _score(model, temperature: float):
    """Log weight, and the key of the draw as a fixed-point number."""

    @F.pandas_udf("log_weight double, key long")
    def score(doc_id: pd.Series, text: pd.Series) -> pd.DataFrame:
        data = [t.encode("utf-8", "surrogatepass") if t else b"" for t in text]
        w = np.array([float(model.value[grams(t)].sum()) for t in data], float)
        noise = _gumbel(doc_id.fillna(-1).astype("int64").to_numpy(), data)
        return pd.DataFrame({"log_weight": w, "key": np.floor((w / temperature + noise) * (1 << 20)).astype(np.int64)})

    return score("doc_id", "text")


def kth_largest(keys: DataFrame, k: int) -> int:
    """The k-th largest of the longs in column ``key`` (1 <= k <= rows), by counting 16 bits at a time."""
    rows = keys.select((F.col("key").bitwiseXOR(F.lit(-(1 << 63)))).alias("key"))
    found = 0
    for shift in (48, 32, 16, 0):
        digit = F.shiftrightunsigned("key", shift).bitwiseAND(F.lit(0xFFFF))
        inside = rows if shift == 48 else rows.filter(F.shiftrightunsigned("key", shift + 16) == F.lit(found))
        counts = sorted(((r["d"], r["count"]) for r in inside.groupBy(digit.alias("d")).count().collect()), reverse=True)  # 2**16 at most
        for d, n in counts:
            if k <= n:
                found = found << 16 | d
                break
            k -= n
    return found - (1 << 63)


def _limit(w: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The log weight below which bad documents outweigh good ones most, COST for a good one."""
    if not good.any() or not bad.any():
        return -LEAST
    order = np.argsort(w, kind="stable")
    w, good, bad = w[order], good[order], bad[order]
    gain = np.cumsum(bad) / bad.sum() - COST * np.cumsum(good) / good.sum()
    last = np.append(w[1:] > w[:-1], True)  # equal weights pass or fail together
    at = int(np.argmax(np.where(last, gain, -np.inf)))
    return min(-LEAST, float(w[at]) + 1e-9) if gain[at] > 0 else NONE


def limits_of(keys: DataFrame, chosen: DataFrame) -> tuple[float, dict[str, float]]:
    """The limit of all held-out documents, and those of the languages that have ``OWN`` good and bad ones."""
    held = keys.join(F.broadcast(chosen.filter("fit > 1")), F.col("doc_id") == F.col("_id")).select("lang", "log_weight", "fit")
    found = held.orderBy("log_weight", "fit", "lang").limit(4 * SAMPLE).toPandas()  # labels are for single documents: only rows that repeat an id can exceed SAMPLE
    w, good, bad = found["log_weight"].to_numpy(), (found["fit"] == 2).to_numpy(), (found["fit"] == 3).to_numpy()
    own = {}
    for lang, at in found.groupby("lang").indices.items():
        if good[at].sum() >= OWN and bad[at].sum() >= OWN:
            own[lang] = _limit(w[at], good[at], bad[at])
    return _limit(w, good, bad), own


def scored(docs: DataFrame, labels: DataFrame, sample: int, k: int | None, temperature: float, weight: str, key: str) -> tuple[DataFrame, DataFrame, int]:
    """``docs`` with its log weight and key in columns of these names, a written table of both by doc_id, and the least key that is drawn.

    A key is that of the document's weight over the limit of its language.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        chosen = scratch.stage(sample_labels(labels, sample))
        model = spark.sparkContext.broadcast(ratios(docs, chosen))  # 4 MB
        has = "lang" in docs.columns
        tongue, s = fresh("tongue", [*docs.columns, weight, key]), fresh("s", docs.columns)
        out = docs.select("*", (F.coalesce(docs["lang"].cast("string"), F.lit("")) if has else F.lit("")).alias(tongue), _score(model, temperature).alias(s))
        out = out.select(*(own(out, c) for c in docs.columns), tongue, F.col(f"{s}.log_weight").alias(weight), F.col(f"{s}.key").alias(key))
        keys = scratch.stage(out.select("doc_id", F.col(tongue).alias("lang"), F.col(weight).alias("log_weight"), F.col(key).alias("key")))
        pooled, owned = limits_of(keys, chosen)

        def limit(column: str) -> Column:
            found = F.lit(pooled)
            if owned:
                found = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in owned.items() for x in pair]), F.col(column)), found)
            return found

        def over(name: str, column: str) -> Column:
            return F.col(name) - F.floor(limit(column) / temperature * (1 << 20)).cast("long")

        if k is None:
            k = keys.filter(F.col("log_weight") >= limit("lang")).count()
        held = scratch.keep(scratch.stage(keys.withColumn("key", over("key", "lang"))))
        k = min(k, held.count())
        return out.withColumn(key, over(key, tongue)).drop(tongue), held, kth_largest(held, k) if k else (1 << 63) - 1


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, k: int | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """doc_id, log_weight, kept of each row of ``docs`` (doc_id, text and, if known, lang), given ``labels`` (doc_id, quality, toxic).

    Null and empty texts have no n-grams: weight 1, so they are kept unless
    the noise is far below the rest.  Rows alike in doc_id, text and lang get
    the same key and are kept or rejected together, as are ties of the last
    key drawn.  Labels without doc_id or quality are ignored; of several for a
    document the worst counts.  Without any good label nothing differs and all
    rows are kept.  An empty table gives no rows.
    """
    _, keys, least = scored(docs.select("doc_id", "text", *(c for c in docs.columns if c == "lang")), labels, sample, k, temperature, "log_weight", "key")
    return keys.select("doc_id", "log_weight", (F.col("key") >= least).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, k: int | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns."""
    weight, key = (fresh(c, docs.columns) for c in ("weight", "key"))
    out, _, least = scored(docs, labels, sample, k, temperature, weight, key)
    return out.filter(F.col(key) >= least).select(*(own(out, c) for c in docs.columns))
