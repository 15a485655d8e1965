"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed as LZ78 does: each phrase is the shortest string not yet in
the dictionary, which then takes it up.  The phrases' hashes are a set, of
which the ``SIGNATURE`` smallest make the fingerprint.  The likeness of two
fingerprints estimates the Jaccard similarity of the phrase sets, which is
high where one text compresses well given the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.arrow import slices, texts
from larkspur.llm.bytehash import U64, prefix, spans

SIGNATURE = 128
#: Bytes of the texts that are looked at together.
SLICE = 1 << 20


def walk(text: str, start: int, root: dict, ends: list[int], base: int = 0, log: list | None = None) -> bool:
    """Parses ``text`` from ``start``, a phrase's beginning, on: adds phrases to the trie ``root`` and their ends, plus ``base``, to ``ends``.

    True where the text ends within a known phrase, which is not added.  log: gets each new node's parent and symbol.
    """
    node = root
    for end, symbol in enumerate(text[start:] if start else text, base + start + 1):
        found = node.get(symbol)
        if found is None:
            node[symbol] = {}
            ends.append(end)
            if log is not None:
                log.append((node, symbol))
            node = root
        else:
            node = found
    return node is not root


def parse(text: str) -> Iterator[tuple[list[int], set[str]]]:
    """Ends of the phrases of the whole text, and the dictionary.  What is left at the end may be a known phrase."""
    ends: list[int] = []
    if walk(text, 0, {}, ends):
        ends.append(len(text))
    yield ends, {text[a:b] for a, b in zip([0, *ends], ends, strict=False)}


def signature(text: str, ends: list[int]) -> np.ndarray:
    """The smallest hashes (32 bits) of the phrases between ``ends``, in ascending order."""
    if not ends:
        return np.zeros(0, np.uint32)
    stop = np.array(ends)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    h = np.unique((spans(prefix(codes), np.concatenate([[0], stop[:-1]]), stop) >> U64(32)).astype(np.uint32))
    return h[:SIGNATURE]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smallest hashes of the union that both have; 1.0 for two empty signatures."""
    both = np.union1d(a, b)[:SIGNATURE]
    return float(np.isin(both, np.intersect1d(a, b)).mean()) if len(both) else 1.0


def to_text(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    """The signature that a fingerprint states."""
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def fingerprint(text: str) -> str:
    """The fingerprint of one text."""
    *_, (ends, _) = parse(text)
    return to_text(signature(text, ends))


def edit(text: str, other: str) -> str:
    """The last third of the text (rounded down) replaced by the first as many code points of another."""
    n = len(text) // 3
    return text[: len(text) - n] + other[:n]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _first(key: np.ndarray, n: int) -> np.ndarray:
    """Which of the ascending keys (owner, hash) are among the SIGNATURE smallest of their owner; owners are below ``n``."""
    own = (key >> U64(32)).astype(np.int64)
    return np.arange(len(key)) - np.searchsorted(own, np.arange(n))[own] < SIGNATURE


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in ascending order, and how often each occurs; on many keys, sorting is several times faster than np.unique's hashing."""
    key.sort()
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[new], np.diff(new, append=len(key))


def _likenesses(sig: np.ndarray, bound: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``likeness`` of the signatures a[i] and b[i], for each i; signature k is sig[bound[k] : bound[k + 1]]."""
    pairs = []
    for side in (a, b):
        size = bound[side + 1] - bound[side]
        pair = np.repeat(np.arange(len(side)), size)
        at = np.arange(len(pair)) + (bound[side] - np.cumsum(size) + size)[pair]
        pairs.append(pair.astype(U64) << U64(32) | sig[at].astype(U64))
    key, times = _distinct(np.concatenate(pairs))
    near = _first(key, len(a))
    own = (key[near] >> U64(32)).astype(np.int64)
    union = np.bincount(own, minlength=len(a))
    both = np.bincount(own[times[near] == 2], minlength=len(a))
    return np.where(union, both / np.maximum(union, 1), 1.0)


def _solve(ids: list, data: list[str], after: list[bool]) -> pa.RecordBatch:
    """Rows of the texts that the next one in ``data`` follows; the others only show what follows."""
    ends: list[int] = []  # of the phrases of all texts, and of the edited texts' from the cut on, in the joined buffer
    buffer, begins, counts, owners, shared = [], [], [], [], []
    shas, base = [], 0

    def note(owner: int, begin: int, before: int, same: int) -> None:
        owners.append(owner), begins.append(begin), counts.append(len(ends) - before), shared.append(same)

    for i, text in enumerate(data):
        root: dict = {}
        before, cut = len(ends), len(text) - len(text) // 3 if after[i] else 0
        if cut:
            walk(text[:cut], 0, root, ends, base)
        same = len(ends) - before
        at = ends[-1] - base if same else 0  # the last phrase's end before the cut
        log: list = []
        if walk(text, at, root, ends, base, log if after[i] else None):
            ends.append(base + len(text))
        note(2 * i, base, before, same)
        buffer.append(text)
        base += len(text)
        if not after[i]:
            continue
        for node, symbol in reversed(log):
            del node[symbol]
        edited = edit(text, data[i + 1])
        shas.append(hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest())
        rest, before = edited[at:], len(ends)
        if walk(rest, 0, root, ends, base):
            ends.append(base + len(rest))
        note(2 * i + 1, base, before, 0)
        buffer.append(rest)
        base += len(rest)

    codes = np.frombuffer("".join(buffer).encode("utf-32-le", "surrogatepass"), "<u4")
    stop, n = np.array(ends, np.int64), np.array(counts, np.int64)
    start = np.concatenate([np.zeros(min(1, len(stop)), np.int64), stop[:-1]])
    first = np.cumsum(n) - n
    start[first[n > 0]] = np.array(begins, np.int64)[n > 0]
    h = spans(prefix(codes), start, stop) >> U64(32)
    owner = np.repeat(np.array(owners, np.int64), n)
    common = np.arange(len(h)) - np.repeat(first, n) < np.repeat(np.array(shared, np.int64), n)  # phrases that the edited text has too
    key, _ = _distinct(np.concatenate([owner, owner[common] + 1]).astype(U64) << U64(32) | np.concatenate([h, h[common]]))
    key = key[_first(key, 2 * len(data))]
    bound = np.searchsorted((key >> U64(32)).astype(np.int64), np.arange(2 * len(data) + 1))
    sig = key.astype(np.uint32)
    raw, ranges = sig.astype(">u4").tobytes(), (4 * bound).tolist()
    rows = [i for i, x in enumerate(after) if x]
    k = 2 * np.array(rows, np.int64)
    columns = (
        [ids[i] for i in rows], [len(data[i]) for i in rows], shas,
        *([raw[ranges[2 * i + e] : ranges[2 * i + e + 1]].hex() for i in rows] for e in (0, 1)),
        _likenesses(sig, bound, k, k + 1), _likenesses(sig, bound, k, k + 2),
    )
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], [x.split()[0] for x in OUT.split(", ")])


_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come bucket by bucket in order; the last of a bucket is the next bucket's first, and gets no row of its own."""
    held: list[tuple] = []  # the last row so far: what follows it may come yet
    for batch in slices(batches, most=SLICE):
        rows = held
        for b, is_halo, doc_id, text in zip(batch["bucket"].to_pylist(), batch["halo"].to_pylist(), batch["doc_id"].to_pylist(), texts(batch["text"]), strict=True):
            if rows and rows[-1][0] == b and rows[-1][1]:
                continue  # a repeat of the bucket's halo
            rows.append((b, is_halo, doc_id, text))
        after = [x[0] == y[0] for x, y in zip(rows, rows[1:], strict=False)] + [False]
        if any(after):
            yield _solve([r[2] for r in rows], [r[3] for r in rows], after)
        held = rows[-1:]


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of ``docs`` (doc_id, text) and of its edited text, and their likeness.

    The next document is the one that follows in descending doc_id (nulls
    last; equal ids by a hash of the text), the first following the last.  A
    single document follows itself.  Null texts count as empty; an empty text
    has an empty fingerprint.  An empty table gives no rows.

    Ids are dealt to buckets by approximate quantiles.  Each bucket also gets a
    copy of the first row of the bucket after it, so that no row needs another bucket.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted({int(x) for x in docs.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.1 / buckets)})
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x > F.col("doc_id"))) if cuts else F.lit(0)
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(place))
    order = F.struct(F.col("doc_id"), F.bitwise_not("h").alias("r"))
    firsts = sorted((r["bucket"], r["first"]["doc_id"], ~r["first"]["r"]) for r in rows.groupBy("bucket").agg(F.max(order).alias("first")).collect())  # a row a bucket
    halo = [(firsts[i - 1][0], doc_id, h) for i, (_, doc_id, h) in enumerate(firsts)]
    halo = F.broadcast(spark.createDataFrame(halo, "bucket int, doc_id_ long, h_ long"))
    copies = rows.drop("bucket").join(halo, F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("h") == F.col("h_"))).drop("doc_id_", "h_")
    every = rows.withColumn("halo", F.lit(False)).unionByName(copies.withColumn("halo", F.lit(True)))
    dealt = every.repartition("bucket").sortWithinPartitions("bucket", "halo", F.desc_nulls_last("doc_id"), "h")
    return dealt.select("bucket", "halo", "doc_id", "text").mapInArrow(_compare, OUT)
