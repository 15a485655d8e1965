"""Packing documents into sequences of a fixed length by fitted length patterns.

1. The histogram of piece lengths (at most ``size`` numbers) goes to the driver.
2. All patterns of up to three lengths that fill a sequence exactly are
   enumerated, and repeat counts fitted to the histogram by non-negative least
   squares (multiplicative updates, which keep every count non-negative).
3. Counts are rounded, remainders carried from pattern to pattern, and packed as far as pieces remain.
4. Residual lengths are packed best-fit, longest first, on the histogram.

The plan says for each range of ranks within a length which sequence and
offset it gets; pieces are ranked within their length by salted windows.  Its
size depends on the sequence length alone, never on the number of documents.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.arrow import slices, texts
from larkspur.llm.workspace import stage

SIZE = 2048
END_ID = 0
ROUNDS = 200
PIECES = "doc_id long, piece int, start long, length long, ids binary"
_encoders: dict = {}


def encoder(vocabulary: str, pattern: str, specials: tuple[tuple[str, int], ...], library: str | None):
    """Texts to ids by a byte-level BPE over a rank file; one for each worker.

    A text that it cannot split (a run of a million blanks exhausts the
    pattern's stack) is encoded by the tokenizers library from its own file.
    """
    key = (vocabulary, library)
    if key not in _encoders:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(specials))
        slow: list = []

        def encode(text: str) -> list[int]:
            try:
                return fast.encode(text, allowed_special="all", disallowed_special=())
            except ValueError:
                if library is None:
                    raise
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(library))
                slow[0].no_truncation()
                slow[0].no_padding()
            return slow[0].encode(text, add_special_tokens=False).ids

        _encoders[key] = encode
    return _encoders[key]


def cut_lengths(n: int, size: int) -> list[int]:
    """Lengths of a document's pieces: only the first may be shorter than ``size``."""
    head = n % size
    return [head] * (head > 0) + [size] * (n // size)


def pieces(docs: DataFrame, vocabulary: str, pattern: str, specials: tuple[tuple[str, int], ...] = (), library: str | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Token ids (little-endian 32 bits) of each document's pieces, ``end_id`` appended; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary, pattern, specials, library), np.array([end_id], "<u4")
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch["doc_id"].to_pylist(), texts(batch["text"]), strict=True):
                ids = np.concatenate([np.array(encode(text), "<u4"), end])
                at = 0
                for k, n in enumerate(cut_lengths(len(ids), size)):
                    for column, value in zip(out, (doc_id, k, at, n, ids[at : at + n].tobytes()), strict=True):
                        column.append(value)
                    at += n
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def patterns(present: np.ndarray, size: int) -> np.ndarray:
    """All patterns of one to three of the present lengths with sum ``size``; rows padded with 0."""
    has = np.zeros(size + 1, bool)
    has[present] = True
    found = [np.array([[size, 0, 0]])] if has[size] else []
    pairs = present[(present * 2 <= size)]
    pairs = pairs[has[size - pairs]]
    pairs = pairs[size - pairs > 0]
    found.append(np.stack([size - pairs, pairs, np.zeros_like(pairs)], axis=1))
    for a in present[present * 3 <= size]:
        b = present[(present >= a) & (present * 2 <= size - a)]
        c = size - a - b
        ok = has[c]
        found.append(np.stack([c[ok], b[ok], np.full(int(ok.sum()), a)], axis=1))
    return np.concatenate(found).astype(np.int64)


def fit_counts(hist: np.ndarray, found: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative least squares of pattern counts x: for each length, uses(x) should be hist."""
    size = len(hist) - 1
    target = hist.astype(float)
    target[0] = 0

    def uses(x: np.ndarray) -> np.ndarray:
        total = sum(np.bincount(found[:, j], weights=x, minlength=size + 1) for j in range(3))
        total[0] = 0
        return total

    def score(r: np.ndarray) -> np.ndarray:
        return r[found[:, 0]] + r[found[:, 1]] + r[found[:, 2]]

    x = np.ones(len(found))
    want = score(target)
    for _ in range(rounds):
        x *= want / np.maximum(score(uses(x)), 1e-12)
    return x


def round_counts(x: np.ndarray) -> np.ndarray:
    """Whole counts; what rounding leaves of a pattern is carried to the next one, which has like lengths, so the sum stays."""
    return np.diff(np.floor(np.cumsum(x) + 0.5), prepend=0.0).astype(np.int64)


def plan(hist: np.ndarray) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, last rank + 1, first sequence, offset, pieces of this length per sequence); number of sequences."""
    size = len(hist) - 1
    left, out, sequences = hist.astype(np.int64).copy(), [], 0
    used = np.zeros_like(left)
    open_bins: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # by free room: (first sequence, how many)

    def place(length: int, count: int, first: int, offset: int, per: int) -> None:
        out.append((length, used[length], used[length] + count, first, offset, per))
        used[length] += count
        left[length] -= count

    present = np.flatnonzero(left)
    found = patterns(present, size) if len(present) else np.zeros((0, 3), np.int64)
    x = fit_counts(hist, found) if len(found) else np.zeros(0)
    whole = round_counts(x)
    for i in np.flatnonzero(whole):
        kinds, need = np.unique(found[i][found[i] > 0], return_counts=True)
        count = min(int(whole[i]), *(left[k] // m for k, m in zip(kinds, need, strict=True)))
        if count > 0:
            offset = 0
            for k, m in zip(kinds, need, strict=True):
                place(int(k), int(count * m), sequences, offset, int(m))
                offset += int(k * m)
            sequences += int(count)

    for length in range(size, 0, -1):
        room = length
        while left[length]:
            while room <= size and not open_bins[room]:
                room += 1
            if room <= size:
                first, bins = open_bins[room].pop()
            else:
                room, first, bins = size, sequences, None
            per = room // length
            n = int(left[length] // per)
            take, per = (n, per) if n else (1, int(left[length]))  # the last bin may get fewer
            if bins is None:
                sequences += take
            else:
                if take < bins:
                    open_bins[room].append((first + take, bins - take))
                take = min(take, bins)
            place(length, take * per, first, size - room, per)
            if room - per * length:
                open_bins[room - per * length].append((first, take))
            room = length
    return np.array(out, np.int64).reshape(-1, 6), sequences


def _assign(rows):
    """Looks a piece's rank up in the plan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = rows.value
        keys = (p[:, 0] << 48) + p[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            r = p[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
            k = rank - r[:, 1]
            seq, offset = r[:, 3] + k // r[:, 5], r[:, 4] + k % r[:, 5] * length
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names if c != "rank"), pa.array(seq), pa.array(offset)], [*(c for c in batch.schema.names if c != "rank"), "sequence_id", "offset"])

    return run


def layout(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length and any others, without ``ids``).

    ``cut`` must be a table that returns the same rows each time, such as a written one.
    """
    spark = cut.sparkSession
    salts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut.withColumn("salt", F.pmod(F.xxhash64(*cut.columns), F.lit(salts)))
    counts = stage(rows.groupBy("length", "salt").agg(F.count("*").alias("n")))
    hist = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        hist[r["length"]] = r["n"]
    found, _ = plan(hist)
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy(*cut.columns))
    ranked = rows.withColumn("own", own).join(before, ["length", "salt"]).select(*cut.columns, (F.col("before") + F.col("own") - 1).alias("rank"))
    schema = ", ".join(f"`{c}` {t}" for c, t in cut.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(_assign(spark.sparkContext.broadcast(found)), schema)


def sequences(cut: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, doc_ids, ids (all pieces' bytes in order).  cut: with ``ids``."""
    both = cut.select("doc_id", "piece", "ids").join(placed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", F.hex("ids").alias("ids"))))
    return both.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.col("p.doc_id").alias("doc_ids"), F.unhex(F.array_join("p.ids", "")).alias("ids"))


def pack(docs: DataFrame, vocabulary: str, pattern: str, specials: tuple[tuple[str, int], ...] = (), library: str | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts give one piece of ``end_id`` alone.  Null and
    repeated doc_ids are packed like any others, row by row.  An empty table
    gives no rows.
    """
    cut = pieces(docs, vocabulary, pattern, specials, library, size, end_id)
    return layout(stage(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))), size)
