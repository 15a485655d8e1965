"""Phrase collocations by contiguous pattern growth over projected occurrence pointers.

1. Word counts per language, added up in each task before they are shuffled.
2. Each occurrence of a frequent word is projected to a pointer: the word and
   the frequent words that follow it in its piece, up to the longest phrase.
   Growth never passes an infrequent word, so pointers end there.  Equal
   pointers are folded into one that carries their number.
3. A prefix of two words is grown by one task, which has all its pointers:
   sorted, they are the depth-first walk of its extensions, and a run of equal
   prefixes is a projection.  A run that is frequent is a pattern, and only
   frequent runs are extended to the right.  The second word spreads the
   pointers of a hot first word over the tasks; folding bounds those of a hot pair.
4. Counts of both parts of each cut are joined, phrases inside longer ones
   removed, and the first of each language returned.

Frequent words reach the tasks as a bit set over checksums, whose size is
fixed; a false hit costs time only, as all counts are exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.arrow import slices, utf8
from larkspur.llm.skew import join_groups
from larkspur.llm.workspace import Scratch, stage

LEAST, LONGEST, TOP, INSIDE_PERCENT = 10, 3, 2000, 50
#: Bits of the set of frequent words: two megabytes.
BITS = 1 << 24
#: Pointers (and words) that a task holds before it folds and emits them.
HELD = 3_000_000
VOCABULARY = (1 << 20) - 2
#: No UTF-8 text has this byte; here it is the border of pieces.
_BORDER = b"\xff"
_BYTES = bytes(0xFF if b in b".,;:!?" or 0x0A <= b <= 0x0D else b for b in range(256)).lower()
UNKNOWN_LANG = "und"


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z only), with a border between pieces."""
    return text.translate(_BYTES).replace(_BORDER, b" \xff ").split()


class Vocabulary(dict):
    """Numbers for the words of a task, from 2; 0 is the border and 1 any word that is not frequent."""

    def __init__(self, lang: str, frequent: np.ndarray | None):
        super().__init__({_BORDER: 0})
        self.lang, self.frequent, self.words = lang, frequent, [b"", b""]

    def __missing__(self, word: bytes) -> int:
        if self.frequent is not None:
            bit = slot(self.lang, word)
            if not self.frequent[bit >> 3] >> (bit & 7) & 1:
                self[word] = 1
                return 1
        self[word] = n = len(self.words)
        self.words.append(word)
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def names(self, numbers: np.ndarray) -> pa.Array:
        return pa.array(self.words, pa.binary()).cast(pa.string()).take(pa.array(numbers))


def slot(lang: str, word: bytes) -> int:
    """The bit of a word."""
    return zlib.crc32(word, zlib.crc32(lang.encode() + b"\n")) & (BITS - 1)


def _by_lang(batches: Iterator[pa.RecordBatch], frequent: np.ndarray | None, emit) -> Iterator[pa.RecordBatch]:
    """Feeds the numbered words of the rows, each text ended by a border, to ``emit`` by language in bounded lots."""
    held: dict[str, tuple[Vocabulary, list[np.ndarray]]] = {}
    n = 0
    for batch in slices(batches):
        for lang, text in zip(batch["lang"].to_pylist(), utf8(batch["text"]), strict=True):
            if lang not in held:
                held[lang] = (Vocabulary(lang, frequent), [])
            numbers = held[lang][0].numbers([*tokens(text), _BORDER])
            held[lang][1].append(numbers)
            n += len(numbers)
            if n >= HELD or len(held[lang][0]) >= VOCABULARY:
                for key, (vocabulary, lots) in held.items():
                    yield from emit(key, vocabulary, lots)
                held, n = {}, 0
    for key, (vocabulary, lots) in held.items():
        yield from emit(key, vocabulary, lots)


def _batch(lang: str, columns: list[pa.Array], counts: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns with their language before and counts behind, in batches of a bounded number of rows."""
    for at in range(0, len(counts), 100_000):
        own = [c.slice(at, 100_000) for c in columns]
        n = len(own[0])
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), n), *own, pa.array(counts[at : at + n], pa.int64())], names)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def emit(lang: str, vocabulary: Vocabulary, lots: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        counts = np.bincount(np.concatenate(lots), minlength=len(vocabulary.words))
        found = np.flatnonzero(counts[2:]) + 2
        yield from _batch(lang, [vocabulary.names(found)], counts[found], ["lang", "word", "n"])

    return _by_lang(batches, None, emit)


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word, n of ``texts`` (lang, text)."""
    return texts.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def bit_set(words: DataFrame) -> np.ndarray:
    """The bits of ``words`` (lang, word), as bytes; what reaches the driver is at most ``BITS`` bits."""
    bit = F.crc32(F.concat(F.col("lang").cast("binary"), F.lit(b"\n"), F.col("word").cast("binary"))).bitwiseAND(BITS - 1)
    parts = words.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 32768).alias("part")).agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(32768))).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in parts.collect():
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _project(frequent, longest: int, names: list[str]):
    """Folded pointers of the frequent words that a frequent word follows."""
    shift = 20

    def emit(lang: str, vocabulary: Vocabulary, lots: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        numbers = np.concatenate(lots)
        numbers = np.concatenate([np.where(numbers == 1, 0, numbers), np.zeros(longest, np.int64)])
        n = len(numbers) - longest
        runs = []
        for first in range(0, longest, 3):  # three words of a pointer make one number
            key, open_ = np.zeros(n, np.int64), np.ones(n, bool)
            for k in range(first + 3):
                follower = numbers[k : k + n] if k < longest else np.zeros(n, np.int64)
                open_ &= follower > 0
                if k >= first:
                    key = key << shift | np.where(open_, follower, 0)
            runs.append(key)
        keep = np.flatnonzero((numbers[:n] > 0) & (numbers[1 : n + 1] > 0))
        if len(runs) == 1:
            found, counts = np.unique(runs[0][keep], return_counts=True)
            found = [found]
        else:
            both, counts = np.unique(np.stack([r[keep] for r in runs], axis=1), axis=0, return_counts=True)
            found = list(both.T)
        mask, columns = (1 << shift) - 1, []
        for k in range(longest):
            own = found[k // 3] >> (shift * (2 - k % 3)) & mask
            named = vocabulary.names(own)
            columns.append(named if k < 2 else pc.if_else(pa.array(own > 0), named, pa.scalar(None, pa.string())))
        yield from _batch(lang, columns, counts, names)

    return lambda batches: _by_lang(batches, np.frombuffer(frequent.value, np.uint8), emit)


def pointers(texts: DataFrame, frequent: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """lang, w1, w2, ... (null behind the last), n: how often this pointer occurs among those folded with it."""
    names = ["lang", *(f"w{k + 1}" for k in range(longest)), "n"]
    schema = ", ".join(f"{c} {'long' if c == 'n' else 'string'}" for c in names)
    return texts.mapInArrow(_project(texts.sparkSession.sparkContext.broadcast(frequent.tobytes()), longest, names), schema)


def _grow(least: int, longest: int):
    """Depth-first growth over sorted pointers; a prefix of two words is whole in one task, and may go on in the next batch."""

    def extend(columns: list[np.ndarray], counts: np.ndarray, lo: int, hi: int, depth: int, out: list[tuple[int, int, int]]) -> None:
        """Patterns that extend the prefix of ``depth`` words that rows lo to hi share."""
        edges = columns[depth]
        starts = [lo, *(edges[np.searchsorted(edges, lo, "right") : np.searchsorted(edges, hi, "left")]).tolist(), hi]
        sums = np.add.reduceat(counts[lo:hi], np.array(starts[:-1]) - lo)
        for k in np.flatnonzero(sums >= least):
            a, b = starts[k], starts[k + 1]
            if not columns[longest][a] > depth:
                continue
            out.append((a, depth + 1, int(sums[k])))
            if depth + 1 < longest:
                extend(columns, counts, a, b, depth + 1, out)

    def grown(rows: pa.RecordBatch) -> pa.RecordBatch:
        """All frequent patterns of rows that hold whole prefixes of two words."""
        n = rows.num_rows
        change = np.zeros(n, bool)
        sizes = np.zeros(n, np.int64)
        columns: list[np.ndarray] = []
        for k, name in enumerate(["lang", *(f"w{k + 1}" for k in range(longest))]):
            change |= _changes(rows[name])
            if k:
                sizes += pc.is_valid(rows[name]).to_numpy(zero_copy_only=False)
                columns.append(np.flatnonzero(change))
        columns.append(sizes)
        counts, out = rows["n"].to_numpy(), []
        starts = columns[1]
        for lo, hi, total in zip(starts.tolist(), [*starts[1:].tolist(), n], np.add.reduceat(counts, starts).tolist(), strict=True):
            if total >= least:
                out.append((lo, 2, total))
                if longest > 2:
                    extend(columns, counts, lo, hi, 2, out)
        at = pa.array([a for a, _, _ in out], pa.int64())
        found = [rows[f"w{k + 1}"].take(at).to_pylist() for k in range(longest)]
        phrases = [[found[k][i] for k in range(size)] for i, (_, size, _) in enumerate(out)]
        return pa.RecordBatch.from_arrays([rows["lang"].take(at), pa.array(phrases, pa.list_(pa.string())), pa.array([c for _, _, c in out], pa.int64())], ["lang", "words", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            prefix = [batch[c] for c in ("lang", "w1", "w2")]
            last = batch.num_rows - 1
            same = pc.and_(pc.and_(*(pc.equal(c, c[last]) for c in prefix[:2])), pc.equal(prefix[2], prefix[2][last])).to_numpy(zero_copy_only=False)
            open_ = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if not open_:
                held = [_fold(held)]  # one prefix has filled a batch
                continue
            whole = pa.Table.from_batches([*held[:-1], batch.slice(0, open_)]).combine_chunks()
            for rows in whole.to_batches():
                yield grown(rows)
            held = [batch.slice(open_)]
        if held:
            for rows in pa.Table.from_batches(held).combine_chunks().to_batches():
                yield grown(rows)

    return run


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before it."""
    known = pc.fill_null(column, "")
    return np.concatenate([[True], pc.not_equal(known.slice(1), known.slice(0, len(known) - 1)).to_numpy(zero_copy_only=False)])


def _fold(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Adds up equal pointers, which follow each other; a prefix then has one row for each of its extensions."""
    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    names = [c for c in rows.schema.names if c != "n"]
    starts = np.flatnonzero(np.logical_or.reduce([_changes(rows[c]) for c in names]))
    return pa.RecordBatch.from_arrays([*(rows[c].take(pa.array(starts)) for c in names), pa.array(np.add.reduceat(rows["n"].to_numpy(), starts))], [*names, "n"])


def patterns(projected: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, words, a of the phrases of two words and more that occur ``least`` times in ``projected`` pointers."""
    names = [f"w{k + 1}" for k in range(longest)]
    prefix = ["lang", "w1", "w2"]
    # the hash makes the sort cheap; it is made behind the shuffle, where it costs no bytes
    dealt = projected.repartition(*prefix).withColumn("h", F.xxhash64(*prefix)).sortWithinPartitions("h", "lang", *names)
    return dealt.select("lang", *names, "n").mapInArrow(_grow(least, longest), "lang string, words array<string>, a long")


def _phrase(words: Column | str) -> Column:
    return F.array_join(words, " ")


def _counted(cuts: DataFrame, counts: DataFrame, part: str, name: str, total: int, scratch: Scratch) -> DataFrame:
    """Adds how often a part of each cut occurs; a part of very many candidates is joined by broadcast."""
    uses = cuts.groupBy("lang", part).agg(F.count("*").alias("uses"))
    groups = scratch.stage(uses.join(counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part]))
    return join_groups(cuts, groups, ["lang", part], "uses", total).drop("uses")


def scored(found: DataFrame, words: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds l, r and score of the lowest-scoring cut to candidates (lang, words, a), and ``phrase``.  Exact while counts are below 10**15."""
    counts = scratch.stage(words.select("lang", F.col("word").alias("phrase"), F.col("n").alias("f")).unionByName(found.select("lang", _phrase("words").alias("phrase"), F.col("a").alias("f"))))
    at, size = F.col("k"), F.size("words")
    cuts = found.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", _phrase("words").alias("phrase"), "words", "a", "k", _phrase(F.slice("words", F.lit(1), at)).alias("left"), _phrase(F.slice("words", at + 1, size - at)).alias("right"))
    cuts = scratch.stage(cuts)
    total = cuts.count()
    both = _counted(scratch.stage(_counted(cuts, counts, "left", "l", total, scratch)), counts, "right", "r", total, scratch)
    a, l_, r = (f"CAST({c} AS DECIMAL(19, 0))" for c in "alr")
    score = F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * {a} * {a}) DIV ({l_} * {r})")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return both.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.first("a").alias("a"), best).select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def outermost(candidates: DataFrame, percent: int = INSIDE_PERCENT) -> DataFrame:
    """Candidates (lang, phrase, words, a) that no longer candidate contains which has at least ``percent`` of their occurrences."""
    size = F.size("words")
    starts = candidates.filter(size > 2).select("lang", "words", "a", F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
    starts = starts.select("*", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)).alias("i"))
    most = starts.select("lang", _phrase(F.slice("words", F.col("i"), F.col("m"))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("outer"))
    both = candidates.join(most, ["lang", "phrase"], "left")
    return both.filter(F.col("outer").isNull() | (100 * F.col("outer") < percent * F.col("a"))).drop("outer")


def ranked(rows: DataFrame, top: int = TOP, parts: int = 64) -> DataFrame:
    """The first ``top`` of each language, with ``rank``; each of ``parts`` shares is cut before they meet."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    first = rows.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top).drop("share", "rank")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, percent: int = INSIDE_PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of two to ``longest`` words of each language.

    ``docs`` (lang, text) may have other columns, which are not read.  A null
    lang is ``und``, a null or empty text has no words.  Repeated rows count
    as often as they come.  Ties of score go to the larger a, then to the
    phrase that is first in UTF-8 byte order.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        texts = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"), docs["text"].alias("text"))
        words = scratch.stage(word_counts(texts))
        frequent = words.filter(F.col("n") >= least)
        found = scratch.stage(patterns(pointers(texts, bit_set(frequent), longest), least, longest))
        rows = scratch.stage(scored(found, frequent, scratch))
        first = ranked(outermost(rows, percent), top)
        totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
        return stage(first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
