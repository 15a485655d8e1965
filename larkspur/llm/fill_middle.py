"""Fill-in-middle transformation by a table-driven automaton over UTF-8 bytes.

A table of states by bytes recognises, in one scan, characters (continuation
bytes start none), unit boundaries and the three sentinels.  Each transition
emits what it counts: a character, the end of a unit, a sentinel.  Texts of a
batch are cut into blocks which advance together, one byte a step; a block
starts from every state until all of them have met (two bytes suffice for this
table), so one scan serves texts of any length.  A second pass walks only the
blocks in which the two cuts lie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.arrow import slices, utf8

SEED = 42
#: Of 100: documents that are transformed, and transformed ones that are written suffix first.
RATE, SUFFIX_FIRST = 50, 80
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
BLOCK = 256
#: No UTF-8 text has this byte: it fills the last block of a text and ends the last unit.
END = 0xFF
_START, _SPACE, _WORD, _OPEN, _NAMED, _DONE = range(6)
#: A transition's counts, as fields of one number: a block has at most 256 of each.
CHAR, UNIT, SENTINEL = 1, 1 << 10, 1 << 20
_FIELD = (1 << 10) - 1


def tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and counts of each transition, by 256 * state + byte."""
    state = np.full((6, 256), _WORD, np.uint8)
    counts = np.zeros((6, 256), np.int32)
    counts[:, [b for b in range(256) if b & 0xC0 != 0x80]] = CHAR
    spaces = [0x20, *range(0x09, 0x0E)]
    state[:, spaces] = _SPACE
    counts[np.ix_((_WORD, _OPEN, _NAMED), spaces)] += UNIT
    state[:, ord("<")] = _OPEN
    state[_OPEN, [s[1] for s in (PREFIX, SUFFIX, MIDDLE)]] = _NAMED
    counts[_NAMED, ord(">")] += SENTINEL
    state[:, END] = _DONE
    counts[:, END] = 0
    counts[[_SPACE, _WORD, _OPEN, _NAMED], END] = UNIT
    return state.reshape(-1), counts.reshape(-1)


_NEXT, _COUNTS = tables()


class Scan:
    """One scan over texts: blocks, the state each starts in, and its counts."""

    def __init__(self, data: list[bytes]):
        blocks = np.array([len(b) // BLOCK + 1 for b in data], np.int64)
        self.first = np.concatenate([[0], np.cumsum(blocks)])
        flat = np.full(int(self.first[-1]) * BLOCK, END, np.uint8)
        for b, at in zip(data, self.first[:-1] * BLOCK, strict=True):
            flat[at : at + len(b)] = np.frombuffer(b, np.uint8)
        self.steps = np.ascontiguousarray(flat.reshape(-1, BLOCK).T)
        n = self.steps.shape[1]
        state = np.repeat(np.arange(6, dtype=np.uint8)[:, None], n, axis=1)
        before = np.zeros((6, n), np.int32)
        merged, after = False, np.zeros(n, np.int32)
        for column in self.steps:
            edge = state.astype(np.int32) << 8 | column
            state = _NEXT[edge]
            if merged:
                after += _COUNTS[edge]
            else:
                before += _COUNTS[edge]
                if (state == state[0]).all():
                    merged, state = True, state[0]
        self.begin = np.full(n, _START, np.uint8)
        if merged:
            self.begin[1:] = state[:-1]
        else:
            now = _START
            for i, row in enumerate(state.T.tolist()):
                self.begin[i] = now
                now = row[now]
        self.begin[self.first[:-1]] = _START
        counts = before[self.begin, np.arange(n)] + after

        def total(field: int) -> np.ndarray:
            return np.concatenate([[0], np.cumsum(counts // field & _FIELD)])

        self.chars, self.units, self.sentinels = total(CHAR), total(UNIT), total(SENTINEL)

    def of(self, totals: np.ndarray) -> np.ndarray:
        """Each text's share of running totals over blocks."""
        return totals[self.first[1:]] - totals[self.first[:-1]]

    def cuts(self, text: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and characters before the end of the given number of units of the given texts."""
        at, chars = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        some = np.flatnonzero(units > 0)
        goal = self.units[self.first[text[some]]] + units[some]
        block = np.searchsorted(self.units, goal, "left") - 1
        left = goal - self.units[block]
        where, state, seen = block - self.first[text[some]], self.begin[block], np.zeros(len(some), np.int32)
        for j in range(BLOCK):
            edge = state.astype(np.int32) << 8 | self.steps[j, block]
            found = (_COUNTS[edge] // UNIT & _FIELD > 0) & ((seen // UNIT & _FIELD) + 1 == left)
            at[some[found]] = where[found] * BLOCK + j
            chars[some[found]] = (self.chars[block] - self.chars[self.first[text[some]]] + (seen // CHAR & _FIELD))[found]
            seen += _COUNTS[edge]
            state = _NEXT[edge]
        return at, chars


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits for a document; a null id counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def transform(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output (text) of each row of ``docs``.

    A unit is a word with the blanks before it, or blanks that end the text.
    The two cuts and the form follow from doc_id alone, whatever the number or
    place of the rows.  Null and empty texts have no units and stay plain, as
    do texts with a sentinel; plain rows have null lengths.  Rows are
    independent: ids may be null or repeat, and other columns are not read.
    An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, data = batch["doc_id"].to_pylist(), utf8(batch["text"])
            scan = Scan(data)
            n = scan.of(scan.units)
            drawn = np.array([draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
            moved = np.flatnonzero((n > 0) & (scan.of(scan.sentinels) == 0) & (drawn[:, 2] % 100 < rate))
            one, two = (drawn[moved, k] % (n[moved] + 1) for k in (0, 1))
            (p, p_chars), (q, q_chars) = (scan.cuts(moved, f(one, two)) for f in (np.minimum, np.maximum))
            forms, outputs = ["plain"] * len(ids), list(data)
            lengths: list[list] = [[None] * len(ids), [None] * len(ids)]
            for k, i in enumerate(moved.tolist()):
                b = data[i]
                prefix, middle, suffix = b[: p[k]], b[p[k] : q[k]], b[q[k] :]
                lengths[0][i], lengths[1][i] = int(p_chars[k]), int(q_chars[k] - p_chars[k])
                if drawn[i, 3] % 100 < suffix_first:
                    forms[i], outputs[i] = "spm", b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
                else:
                    forms[i], outputs[i] = "psm", b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
            columns = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(forms), *(pa.array(x, pa.int64()) for x in lengths), pa.array(outputs, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The exact text from what ``transform`` wrote: its own sentinels are the only ones in it, unless it is plain."""
    part = F.split(output, "<[PSM]>", -1)
    return (
        F.when(form == "psm", F.concat(part[1], part[3], part[2]))
        .when(form == "spm", F.concat(part[2], part[3], part[1]))
        .otherwise(output)
    )
