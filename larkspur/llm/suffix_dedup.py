"""Removal of repeated passages by a depth-limited radix sort of suffixes.

Suffixes are ordered only through ``window`` bytes: two that agree so far fall
into one group, and the groups with two members or more are exactly the
windows that occur more than once.  The passes go from the most significant
digit on, and each drops suffixes that are alone in their group:

* Digit 1 is content-defined.  In each window the anchor is the k-gram with
  the smallest hash (leftmost of equal ones), so equal windows have equal
  anchors at equal offsets.  All windows of one anchor form a row, which is a
  few hundred times fewer rows than suffixes.  Rows whose anchor occurs once
  cannot repeat and leave.
* Digit 2 is the rest of the window.  The text around each surviving anchor
  goes to its group, where all windows are hashed by their offset and full
  content and sorted; runs of equal keys are the repeated windows.

The symbols of a text are its bytes or, for a window in words, the hashes of its
words.

Anchors with more than ``GROUP_ROWS`` members are hot: their windows become
rows that are counted by hash with map-side combining, so no task holds them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.arrow import slices, utf8
from larkspur.llm.bytehash import U64, mix, prefix, spans
from larkspur.llm.skew import join_groups
from larkspur.llm.workspace import Scratch, fresh, own

WINDOW = 400
#: Bytes of an anchor's k-gram, as a share of the window.
GRAM_SHARE = 4
#: Most members of an anchor's group that one task takes.
GROUP_ROWS = 16_384
#: Most texts whose keys are broadcast to pick them from all others (16 bytes each).
BROADCAST_ROWS = 500_000
#: Longest piece of a text that is looked at at once; pieces overlap by a window.
PIECE = 1 << 18
#: Symbols around anchors that are hashed at once, and rows of them that are looked at at once.
SYMBOLS, ROWS = 1 << 17, 512
_POS = U64((1 << 24) - 1)
_WORD = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word, a run without ASCII white space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[np.frombuffer(data, np.uint8)]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def symbols(data: bytes, words: bool) -> np.ndarray:
    """The bytes of a text, or hashes of its words."""
    codes = np.frombuffer(data, np.uint8)
    return spans(prefix(codes), *word_bounds(data)) if words else codes


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` values, from block-wise running minima."""
    n = len(x) - w + 1
    pad = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, U64)
    pad[: len(x)] = x
    blocks = pad.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and position of each anchor, and the first and last window that it stands for."""
    gram = max(1, window // GRAM_SHARE)
    parts = []
    for base in range(0, max(1, len(data) - window + 1), PIECE):
        codes = data[base : base + PIECE + window - 1]
        if len(codes) < window:
            continue
        pre = prefix(codes)
        at = np.arange(len(codes) - gram + 1)
        h = spans(pre, at, at + gram)
        least = _sliding_min((h & ~_POS) | at.astype(U64), window - gram + 1)
        pos = (least & _POS).astype(np.int64)
        first = np.flatnonzero(np.diff(pos, prepend=-1))
        last = np.append(first[1:], len(pos)) - 1
        p = pos[first]
        parts.append((h[p].view(np.int64), p + base, first + base, last + base))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchor_rows(window: int, words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            found = [anchors(symbols(t, words), window) for t in utf8(batch["text"])]
            n = [len(x[0]) for x in found]
            doc = np.repeat(np.arange(len(n)), n)
            cols = [np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch["k1"].take(pa.array(doc)), batch["k2"].take(pa.array(doc)), pa.array(cols[0]), pa.array(cols[1].astype(np.int32)), pa.array(cols[2].astype(np.int32)), pa.array(cols[3].astype(np.int32))],
                ["k1", "k2", "anchor", "pos", "lo", "hi"],
            )

    return run


def _contexts(window: int, words: bool):
    """For each surviving anchor of a text, the symbols that its windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            k1, k2, ids, pos, lo, part = [], [], [], [], [], []
            for a, b, text, rows in zip(batch["k1"].to_pylist(), batch["k2"].to_pylist(), utf8(batch["text"]), batch["found"].to_pylist(), strict=True):
                whole = symbols(text, words)
                for r in rows:
                    k1.append(a), k2.append(b), ids.append(r["anchor"]), pos.append(r["pos"]), lo.append(r["lo"])
                    part.append(whole[r["lo"] : r["hi"] + window].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(ids, pa.int64()), pa.array(pos, pa.int32()), pa.array(lo, pa.int32()), pa.array(part, pa.binary())],
                ["k1", "k2", "anchor", "pos", "lo", "part"],
            )

    return run


def _window_keys(anchor: np.ndarray, pos: np.ndarray, lo: np.ndarray, parts: list[bytes], window: int, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key of each window of each row (its anchor, its offset from it and its content), its row and its start.

    Only the 16 bytes that it returns for a window are held for all rows; a row has fewer than two windows' symbols.
    """
    step = max(1, SYMBOLS // (2 * window))
    found = [_some_keys(anchor[i : i + step], pos[i : i + step], lo[i : i + step], parts[i : i + step], window, words) for i in range(0, len(parts), step)]
    if not found:
        return np.zeros(0, U64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    for i, (_, row, _) in enumerate(found):
        row += i * step
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _some_keys(anchor: np.ndarray, pos: np.ndarray, lo: np.ndarray, parts: list[bytes], window: int, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = np.dtype(U64 if words else np.uint8)
    sizes = np.array([len(x) // kind.itemsize for x in parts], np.int64)
    n = sizes - window + 1
    pre = prefix(np.frombuffer(b"".join(parts), kind))
    row = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(np.cumsum(sizes) - sizes, n) + k
    key = spans(pre, start, start + window)
    at = lo[row] + k
    return mix(key + anchor[row].view(U64)) ^ mix((pos[row] - at).astype(U64)), row.astype(np.int32), at.astype(np.int32)


def _repeats(key: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(key)
    same = np.diff(key[order]) == 0
    twice = np.zeros(len(key), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice


def _runs(row: np.ndarray, at: np.ndarray, hit: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and ranges covered by the hit windows; neighbouring windows make one range."""
    row, at = row[hit], at[hit]
    new = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1))
    last = np.append(new[1:], len(row)) - 1
    return row[new], at[new], at[last] + window if len(new) else at[:0]


_RANGES = "k1 long, k2 long, start int, stop int"


def _range_batch(batch: dict, row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(batch["k1"][row]), pa.array(batch["k2"][row]), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))],
        ["k1", "k2", "start", "stop"],
    )


def _read(batch: pa.RecordBatch) -> dict:
    out = {c: batch[c].to_numpy(zero_copy_only=False) for c in ("k1", "k2", "anchor", "pos", "lo")}
    return out | {"part": batch["part"].to_pylist()}


def _sort_groups(window: int, words: bool):
    """Rows come ordered by anchor; as many whole groups as fit are sorted at once."""

    def solve(held: list[dict]) -> pa.RecordBatch:
        x = {c: np.concatenate([h[c] for h in held]) for c in ("k1", "k2", "anchor", "pos", "lo")}
        key, row, at = _window_keys(x["anchor"], x["pos"], x["lo"], [p for h in held for p in h["part"]], window, words)
        return _range_batch(x, *_runs(row, at, _repeats(key), window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = _read(whole.slice(start, ROWS))
                a = batch["anchor"]
                cut = int(np.searchsorted(a, a[-1]))  # the last group may go on
                if held and cut == 0 and held[-1]["anchor"][-1] != a[0]:
                    yield solve(held)
                    held = []
                if cut:
                    held.append({c: v[:cut] for c, v in batch.items()})
                    yield solve(held)
                    held = []
                held.append({c: v[cut:] for c, v in batch.items()})
        if held:
            yield solve(held)

    return run


def _explode_windows(window: int, words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                x = _read(whole.slice(start, 256))
                key, row, at = _window_keys(x["anchor"], x["pos"], x["lo"], x["part"], window, words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x["k1"][row]), pa.array(x["k2"][row]), pa.array(at.astype(np.int32)), pa.array(key.view(np.int64))],
                    ["k1", "k2", "at", "key"],
                )

    return run


def keys(docs: DataFrame) -> tuple[Column, Column]:
    """Two hashes that stand for a row of ``docs``; rows alike in doc_id and text share them."""
    text = F.coalesce(docs["text"], F.lit(""))
    return F.xxhash64(docs["doc_id"], text, F.lit(1)), F.xxhash64(text, docs["doc_id"], F.lit(2))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and the ``keys`` k1 and k2."""
    k1, k2 = keys(docs)
    return docs.select(docs["doc_id"], F.coalesce(docs["text"], F.lit("")).alias("text"), k1.alias("k1"), k2.alias("k2"))


def _fold_copies(rows: DataFrame, size: Column, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of each text that makes up over a thousandth of the rows, one row for the search; and the copies' ranges.

    All windows of such a text repeat.  There are fewer than a thousand such
    texts, so a broadcast of their hashes is bounded.
    """
    hashes = {"t1": F.xxhash64("text"), "t2": F.xxhash64("text", F.lit(3))}
    slim = rows.select("doc_id", *[v.alias(k) for k, v in hashes.items()]).groupBy("t1", "t2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    slim = scratch.stage(slim.filter("n > 1"))
    large = F.broadcast(slim.filter(F.col("n") > rows.count() // 1000).select("t1", "t2", "first"))
    marked = rows.withColumns(hashes)
    copies = marked.join(large, ["t1", "t2"]).select("k1", "k2", F.lit(0).alias("start"), size.alias("stop"))
    once = marked.join(large.withColumn("hot", F.lit(True)), ["t1", "t2"], "left").filter("hot is null or doc_id <=> first")
    return once.select(*rows.columns), copies


def _pick(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows whose (k1, k2) are in ``chosen`` (staged, distinct): before a shuffle, where their number allows a broadcast."""
    return rows.join(F.broadcast(chosen.select("k1", "k2")), ["k1", "k2"], "left_semi") if chosen.count() <= BROADCAST_ROWS else rows


def _long_enough(rows: DataFrame, window: int, words: bool) -> DataFrame:
    """Rows that may have a window; words need a byte and a blank each."""
    return rows.filter(F.octet_length("text") >= (2 * window - 1 if words else window))


def _join_hits(hits: DataFrame, window: int) -> DataFrame:
    """Ranges of a hot group's hit windows, those that touch made one, so that a text gets a row for each range and not for each byte."""
    by = Window.partitionBy("k1", "k2").orderBy("at")
    marked = hits.withColumn("new", (F.col("at") > F.lag("at", 1, -window - 1).over(by) + window).cast("int")).withColumn("run", F.sum("new").over(by))
    return marked.groupBy("k1", "k2", "run").agg(F.min("at").alias("start"), (F.max("at") + window).alias("stop")).drop("run")


def repeated_ranges(docs: DataFrame, window: int, words: bool, scratch: Scratch) -> DataFrame:
    """Ranges [start, stop) of the bytes or words of the texts that are covered by windows which occur elsewhere too; k1, k2: see ``keys``.

    A row for each run of neighbouring windows of an anchor; the ranges of a
    text may touch or overlap.  Texts shorter than the window have none.  Rows
    that are alike in doc_id and text repeat one another like any others.
    The result stands on tables of ``scratch``.
    """
    size = F.size(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))) if words else F.octet_length("text")
    rows, copies = _fold_copies(_long_enough(keyed(docs), window, words), size, scratch)
    copies = copies.filter(F.col("stop") >= window)
    found = scratch.stage(rows.select("k1", "k2", "text").mapInArrow(_anchor_rows(window, words), "k1 long, k2 long, anchor long, pos int, lo int, hi int"))
    sizes = scratch.stage(found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"))
    kept = join_groups(found, sizes, ["anchor"], "n", found.count())
    by_text = scratch.stage(kept.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "pos", "lo", "hi")).alias("found")))
    scratch.drop(found)
    few = _pick(rows.select("k1", "k2", "text"), by_text)
    contexts = scratch.stage(few.join(by_text, ["k1", "k2"]).select("k1", "k2", "text", "found").mapInArrow(_contexts(window, words), "k1 long, k2 long, anchor long, pos int, lo int, part binary"))
    scratch.drop(by_text)
    hot = sizes.filter(F.col("n") > GROUP_ROWS).select("anchor")  # fewer than rows / GROUP_ROWS
    hot = F.broadcast(hot) if hot.count() <= 10_000 else hot
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cold = contexts.join(hot, "anchor", "left_anti").repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_sort_groups(window, words), _RANGES)
    windows = contexts.join(hot, "anchor", "left_semi").mapInArrow(_explode_windows(window, words), "k1 long, k2 long, at int, key long")
    cold = cold.unionByName(copies)
    if not hot.limit(1).count():
        return cold
    windows = scratch.stage(windows)
    counts = scratch.stage(windows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    hits = join_groups(windows, counts, ["key"], "n", windows.count())
    return cold.unionByName(_join_hits(hits.select("k1", "k2", "at"), window))


def _without(text: bytes, gone: list[list[int]]) -> bytes:
    """The text without the ranges and without the characters that they cut in two."""
    keep, at = [], 0
    for a, b in gone:
        while 0 < a < len(text) and text[a] & 0xC0 == 0x80:
            a -= 1
        keep.append(text[at : max(a, at)])
        while b < len(text) and text[b] & 0xC0 == 0x80:
            b += 1
        at = b
    return b"".join([*keep, text[at:]])


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
_CUT = T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("rest", T.BinaryType()), T.StructField("clean", T.BinaryType()), T.StructField("less", T.BinaryType())])


def _merged(ranges: Iterable[tuple[int, int]]) -> list[list[int]]:
    """Ranges in order, those that touch or overlap made one."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


@F.arrow_udf(_CUT)
def _cut(text: pa.Array, ranges: pa.Array) -> pa.Array:
    """What is left of each text without its ranges."""
    removed, spans_, rest, clean, less = [], [], [], [], []
    for data, found in zip(utf8(text), ranges.to_pylist(), strict=True):
        keep, at = [], 0
        first, end = word_bounds(data) if any(r["words"] for r in found) else ((), ())
        places = [(int(first[r["start"]]), int(end[r["stop"] - 1])) if r["words"] else (r["start"], r["stop"]) for r in found]
        gone = _merged(x for x, r in zip(places, found, strict=True) if not r["beside"])
        for a, b in gone:
            keep.append(data[at:a])
            at = b
        keep.append(data[at:])
        clean.append(_without(data, gone))
        less.append(_without(data, _merged(places)) if any(r["beside"] for r in found) else None)
        removed.append(sum(b - a for a, b in gone))
        spans_.append([{"start": a, "stop": b} for a, b in gone])
        rest.append(b"".join(keep))
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.StructArray.from_arrays([pa.array(removed, pa.int64()), pa.array(spans_, span), *(pa.array(x, pa.binary()) for x in (rest, clean, less))], ["n_removed", "spans", "rest", "clean", "less"])


def cut(docs: DataFrame, window: int | None = WINDOW, words: int | None = None, name: str = "cut", beside: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text and others) with a struct ``name``, null where a text stays whole: n_removed, spans (maximal removed runs), rest (bytes left), clean (those of whole characters), less.

    Bytes go that are covered by a string of ``window`` bytes which occurs
    elsewhere, and words that are covered by a passage of ``words`` words which
    does; None: no such search.  Passages of ``beside`` words count in the
    field ``less`` only: ``clean`` without them too, or null where there are
    none.  Only the texts that lose something are shuffled.
    Windows are compared by hashes of 64 bits that cover all their content.
    """
    with Scratch(docs.sparkSession) as scratch:
        found = [repeated_ranges(docs, n, kind, scratch).withColumns({"words": F.lit(kind), "beside": F.lit(more)}) for n, kind, more in ((window, False, False), (words, True, False), (beside, True, True)) if n]
        ranges = reduce(DataFrame.unionByName, found)
        ranges = scratch.keep(scratch.stage(ranges.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "stop", "words", "beside")).alias("ranges"))))
    a, b, r = (fresh(c, [*docs.columns, name]) for c in ("k1", "k2", "ranges"))
    ranges = ranges.select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("ranges").alias(r))
    k1, k2 = keys(docs)
    marked = docs.select("*", k1.alias(a), k2.alias(b))
    out = [own(marked, c) for c in docs.columns]
    if ranges.count() > BROADCAST_ROWS:
        return marked.join(ranges, [a, b], "left").select(*out, F.when(F.col(r).isNotNull(), _cut(marked["text"], F.coalesce(r, F.array().cast(ranges.schema[r].dataType)))).alias(name))
    ids = F.broadcast(ranges.select(a, b))
    lost = marked.join(ids, [a, b], "left_semi").join(ranges, [a, b]).select(*out, _cut(marked["text"], F.col(r)).alias(name))
    return lost.unionByName(marked.join(ids, [a, b], "left_anti").select(*out, F.lit(None).cast(_CUT).alias(name)))


def cut_texts(docs: DataFrame, window: int | None = WINDOW, words: int | None = None) -> DataFrame:
    """The texts that lose bytes, once each: the ``keys`` k1 and k2, and the fields of ``cut``."""
    out = cut(docs.select("doc_id", "text"), window, words).filter("cut is not null")
    k1, k2 = keys(out)
    return out.select(k1.alias("k1"), k2.alias("k2"), "cut.*").dropDuplicates(["k1", "k2"])


def remove_repeats(docs: DataFrame, window: int | None = WINDOW, words: int | None = None) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text``; all other columns stay, n_chars is counted anew.

    A character of which some byte was cut goes as a whole.  Null texts stay
    null; an empty table gives an empty one.
    """
    name = fresh("cut", docs.columns)
    out = cut(docs, window, words, name)
    text = F.coalesce(F.col(f"{name}.clean").cast("string"), out["text"])
    new = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*(new.get(c, own(out, c)) for c in docs.columns))
