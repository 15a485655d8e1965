"""First-fit decreasing over a tournament tree of bin capacities, in random groups of documents.

1. Documents are encoded once; a document of more than one sequence is cut
   into whole sequences and a rest.  What is written per piece is its length
   and checksum, and for one document in ``FILLER`` its ids as well.
2. Pieces are dealt at random to groups of about ``GROUP``, by a hash of their
   written row number, so equal rows spread as any others do.
3. Each group packs its pieces first-fit decreasing, longest first: the tree
   holds in each node the largest room below it, and the first bin with enough
   room is found from the root in a step for each level.
4. The filler documents are then cut freely into the room that is left, the
   fullest bins first, then into whole sequences; their last tokens go to sequences
   whose lengths are powers of two, which need no padding.

A group is a task of bounded memory: lengths of all its pieces, and the ids of
a thirty-second of its documents.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.arrow import slices, texts
from larkspur.llm.bpe import byte_symbols
from larkspur.llm.workspace import stage

SIZE = 4096
END_ID = 2
GROUP = 4096
FILLER = 32
#: Chunks whose ids a worker keeps: all until there are so many, and frequent ones in a dictionary that stays in the processor's cache.
CACHE, HOT = 1_000_000, 30_000
PLACED = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_SPACES = regex.compile(r"\s+")
#: str.split takes these for white space, the tokenizers do not.
_NO_SPACES = frozenset("\x1c\x1d\x1e\x1f")
#: Marks that normalisation may compose with an ASCII letter, differently for its two cases.
_MARKS = regex.compile("[\u0300-\u036f]")
_ENDS = frozenset(".,;:!?")
#: The one letter whose lower case ends in a mark, which is no letter.
_DOTTED = "\u0130"
#: A word of one token.
MARK = "|"
_encoders: dict = {}


def _is_word(chunk: str) -> bool:
    """Letters of the alphabets that every Unicode version has, which normalising leaves as they are."""
    return chunk.isalpha() and chunk == chunk.lower() and (chunk.isascii() or (max(chunk) < "\u0530" and unicodedata.is_normalized("NFC", chunk)))


class Encoder:
    """Ids of texts, as little-endian numbers of 32 bits, by the tokenizers library.

    It serves tokenizers that lower their input, drop white space and split
    words from punctuation.  A text is then the sequence of its
    white-space-separated chunks; each is encoded by the library once while it
    stays in the cache.  What would only fill the cache is folded first: the
    case of ASCII letters, and one mark behind a letter, which is always a word of its own.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.opening = {t.content[:2] for t in self.library.get_added_tokens_decoder().values()}
        (self.mark_id,) = self.ids(MARK)
        self.model, self.symbols = self.library.model, dict(enumerate(byte_symbols()))
        self.cache: dict[str, bytes] = {}
        self.hot: dict[str, bytes] = {}

    def plain(self, text: str) -> bool:
        """Whether a text has none of the special tokens, nor the beginning of one."""
        return not any(o in text for o in self.opening)

    def chunks(self, text: str) -> list[str]:
        if self.plain(text) and (text.isascii() or not _MARKS.search(text)):
            text = text.encode().lower().decode()
        return text.split() if not any(c in text for c in _NO_SPACES) else [c for c in _SPACES.split(text) if c]

    def learn(self, chunks: list[str]) -> None:
        """Adds the ids of chunks.

        A word of lower-case letters needs no normalising or splitting, and
        goes to the library's model as it is; all others are encoded together,
        with a mark between any two that none of them has.
        """
        words = [c for c in chunks if _is_word(c)]
        self.cache.update((c, array("I", [t.id for t in self.model.tokenize(c if c.isascii() else c.encode().decode("latin-1").translate(self.symbols))]).tobytes()) for c in words)
        chunks = list(set(chunks).difference(words))
        for at in range(0, len(chunks), 2048):
            part = chunks[at : at + 2048]
            text = "".join(part)
            if MARK in text or not self.plain(text):
                odd = [c for c in part if MARK in c or not self.plain(c)]
                self.cache.update((c, self.ids(c).tobytes()) for c in odd)
                part = list(set(part).difference(odd))
            ids = self.ids(f" {MARK} ".join(part))
            data, ends = ids.tobytes(), (np.flatnonzero(ids == self.mark_id) * 4).tolist()
            for c, a, b in zip(part, [-4, *ends], [*ends, len(data)], strict=bool(part)):
                self.cache[c] = data[a + 4 : b]

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def encode(self, batch: list[str]) -> Iterator[bytes]:
        """Ids of each text.  What the first texts say most moves to the small dictionary; long chunks are kept no longer than that."""
        hot, cold = self.hot, self.cache
        if len(cold) > CACHE:
            cold.clear()
        found, open_, new = [], [], set()
        for t in batch:
            chunks = self.chunks(t)
            parts = list(map(hot.get, chunks))
            for i in [i for i, p in enumerate(parts) if p is None]:
                c = chunks[i]
                if (ids := cold.get(c)) is None:
                    new.add(c)
                    open_.append((parts, i, c))
                else:
                    parts[i] = ids
            found.append(parts)
        ended = [c for c in new if c[-1] in _ENDS and c[-2:-1].isalpha() and c[-2] != _DOTTED]
        wanted = new.difference(ended).union(_ENDS, [c[:-1] for c in ended])
        self.learn([c for c in wanted if c not in cold])
        for c in ended:
            cold[c] = cold[c[:-1]] + cold[c[-1]]
        for parts, i, c in open_:
            parts[i] = cold[c]
        if len(hot) < HOT:
            said = Counter(c for _, _, c in open_).most_common(HOT - len(hot))
            hot.update((c, cold[c]) for c, n in said if n > 1)
        for c in [c for c in new | wanted if len(c) >= 64]:
            del cold[c]
        yield from map(b"".join, found)


def encoder(path: str) -> Encoder:
    """One for each worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _rows(docs: DataFrame) -> DataFrame:
    """A number for each row of ``docs``, and a hash of it, beside its id and text."""
    row = F.monotonically_increasing_id()
    return docs.select(row.alias("row"), F.pmod(F.xxhash64(row), F.lit(1 << 30)).alias("h"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def encoded(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """row (one for each row of ``docs``, as in ``pack``), doc_id, ids of its text with ``end_id`` behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path).encode, end_id.to_bytes(4, "little")
        for batch in slices(batches):
            ids = [i + end for i in encode(texts(batch["text"]))]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], pa.array(ids, pa.binary())], ["row", "doc_id", "ids"])

    return _rows(docs).mapInArrow(run, "row long, doc_id long, ids binary")


def pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, filler: int = FILLER) -> DataFrame:
    """Encoded documents cut into whole sequences and a rest; a filler document stays whole and keeps its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path).encode, end_id.to_bytes(4, "little")
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(7)]
            known = (batch[c].to_pylist() for c in ("row", "doc_id", "h"))
            for row, doc_id, h, ids in zip(*known, encode(texts(batch["text"])), strict=True):
                ids += end
                n, loose = len(ids) // 4, h % filler == 0
                for at in (0,) if loose else range(0, n, size):
                    part = ids if loose else ids[4 * at : 4 * (at + size)]
                    for column, value in zip(out, (row, doc_id, at, len(part) // 4, zlib.crc32(part), n, part if loose else None), strict=True):
                        column.append(value)
            kinds = (*[pa.int64()] * 6, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return _rows(docs).mapInArrow(run, "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


class Tournament:
    """Bins of equal size in the order in which they were opened; each node of the tree has the largest room below it."""

    def __init__(self, bins: int, size: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [size] * (2 * self.leaves)

    def first(self, length: int) -> int:
        """The first bin with room for ``length``, which must exist."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < length:
                at += 1
        return at - self.leaves

    def fill(self, b: int, length: int) -> int:
        """Takes ``length`` from a bin's room; returns where in the bin it begins, counted from the room's end."""
        room, at = self.room, b + self.leaves
        before = room[at]
        room[at] = now = before - length
        while at > 1:
            other = room[at ^ 1]
            at >>= 1
            now = other if other > now else now
            if room[at] == now:
                break
            room[at] = now
        return before


def first_fit_decreasing(lengths: list[int], size: int) -> tuple[list[tuple[int, int]], list[int]]:
    """(bin, offset) of each length, and the room that each bin has left.  No length is more than ``size``."""
    tree = Tournament(len(lengths), size)
    place: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    bins = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = tree.first(lengths[i])
        place[i] = (b, size - tree.fill(b, lengths[i]))
        bins = max(bins, b + 1)
    return place, tree.room[tree.leaves : tree.leaves + bins]


def powers(n: int) -> list[int]:
    """Powers of two that add up to n, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def slots(rooms: list[int], tokens: int, size: int) -> Iterator[tuple[int, int, int]]:
    """(bin, offset, length) for loose tokens: room of bins, least first, then whole new bins, then powers of two."""
    bins = len(rooms)
    for room, b in sorted((r, b) for b, r in enumerate(rooms) if r):
        if tokens <= 0:
            return
        yield b, size - room, min(room, tokens)
        tokens -= min(room, tokens)
    if tokens > 0:
        for length in [size] * (tokens // size) + powers(tokens % size):
            yield bins, 0, length
            bins += 1


def _pack(size: int):
    """Packs one group."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group[c].to_pylist() for c in ("row", "start", "doc_id", "length", "ids_crc32", "doc_tokens", "ids")), strict=True), key=lambda r: r[:2])
        firm, loose = [r for r in rows if r[6] is None], [r for r in rows if r[6] is not None]
        place, rooms = first_fit_decreasing([r[3] for r in firm], size)
        base = key[0].as_py() << 32
        out = [(r[0], r[2], r[1], r[3], r[4], r[5], base + b, at) for r, (b, at) in zip(firm, place, strict=True)]
        stream, start = iter(loose), 0
        r = next(stream, None)
        for b, offset, room in slots(rooms, sum(r[3] for r in loose), size):
            while room:
                n = min(room, r[3] - start)
                out.append((r[0], r[2], start, n, zlib.crc32(r[6][4 * start : 4 * (start + n)]), r[5], base + b, offset))
                room, offset, start = room - n, offset + n, start + n
                if start == r[3]:
                    r, start = next(stream, None), 0
        names = [c.split()[0] for c in PLACED.split(", ")]
        columns = list(zip(*out, strict=True)) or [[]] * len(names)
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(names, columns, strict=True)})

    return run


def pack(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, group: int = GROUP, filler: int = FILLER) -> DataFrame:
    """row, doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece of ``docs`` (doc_id, text).

    A document is its ids and then ``end_id``; null and empty texts are
    ``end_id`` alone.  ``row`` tells rows apart: doc_ids may be null or repeat,
    and each row is packed.  Every id is in exactly one piece.  Sequences below
    ``size`` that are not a power of two remain only in groups whose filler
    documents are used up.  Columns other than doc_id and text are not read;
    an empty table gives no rows.
    """
    cut = stage(pieces(docs, path, size, end_id, filler))
    groups = max(1, -(-cut.count() // group))
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("start", "row"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(_pack(size), PLACED)


def sequences(ids: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, doc_ids, ids (all pieces' bytes in order).

    ids: the same documents as ``placed``, by ``encoded``, in a written table.
    """
    part = F.hex(F.substring("ids", 4 * F.col("start") + 1, 4 * F.col("length")))
    both = placed.join(ids.select("row", "ids"), "row").select("sequence_id", F.struct("offset", "doc_id", part.alias("ids")).alias("p"))
    return both.groupBy("sequence_id").agg(F.sort_array(F.collect_list("p")).alias("p")).select("sequence_id", F.col("p.doc_id").alias("doc_ids"), F.unhex(F.array_join("p.ids", "")).alias("ids"))
