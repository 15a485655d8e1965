"""BPE encoding and decoding with contiguous rank arrays.

A short word is an array of part boundaries beside an array with the rank of
each part joined to its right neighbour.  The least rank is searched again and
again, the boundary behind it deleted, and the ranks on both sides refreshed.
Words of more than ``SHORT`` symbols use a heap over linked parts instead, so
a very long word costs n log n.

White space never reaches a token of this tokenizer, so a text is the sequence
of its white-space-separated chunks; encoded chunks are kept in a bounded cache.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from larkspur.llm.arrow import slices, texts

SHORT = 96
#: Chunks that a worker keeps; the cache starts anew when full.
CACHE = 400_000
_NEVER = 1 << 60
_loaded: dict = {}


def byte_symbols() -> list[str]:
    """The printable character for each byte, as byte-level BPE writes it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a tokenizer file with word-end suffix, lower-casing and byte-level symbols."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.specials.items()})
        self.split_specials = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")")
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.space = regex.compile(r"\s+")
        symbols = byte_symbols()
        self.inner = [self.vocab[s] for s in symbols]
        self.last = [self.vocab[s + self.suffix] for s in symbols]
        self.cache: dict[str, tuple[str, str, int]] = {}

    def normalise(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # character by character: no final sigma
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def merge(self, word: str) -> list[int]:
        """Ids of one word."""
        data = word.encode("utf-8")
        parts = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        return self._scan(parts) if len(parts) <= SHORT else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        ranks, none = self.ranks, (_NEVER, 0)
        joined = [ranks.get(p, none) for p in zip(parts, parts[1:], strict=False)]
        while joined:
            least = min(joined)
            if least is none or least[0] == _NEVER:
                break
            i = joined.index(least)
            parts[i] = least[1]
            del parts[i + 1], joined[i]
            if i < len(joined):
                joined[i] = ranks.get((parts[i], parts[i + 1]), none)
            if i:
                joined[i - 1] = ranks.get((parts[i - 1], parts[i]), none)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        n, ranks = len(parts), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*found, i, parts[i], parts[i + 1]) for i in range(n - 1) if (found := ranks.get((parts[i], parts[i + 1])))]
        heap = [(rank, i, new, a, b) for rank, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = new, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if found := ranks.get((new, parts[after[i]])):
                    heapq.heappush(heap, (found[0], i, found[1], new, parts[after[i]]))
            if before[i] >= 0 and (found := ranks.get((parts[before[i]], new))):
                heapq.heappush(heap, (found[0], before[i], found[1], parts[before[i]], new))
        return [p for p in parts if p is not None]

    def encode(self, text: str) -> list[int]:
        """Ids of a text, as the tokenizer file states, without added special tokens."""
        out: list[int] = []
        for piece in self.split_specials.split(text):
            if piece in self.specials:
                out.append(self.specials[piece])
            elif piece:
                for word in self.words.findall(self.normalise(self.space.sub(" ", unicodedata.normalize("NFC", piece)))):
                    out += self.merge(word)
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space; the file names no decoder."""
        return " ".join(self.tokens[i] for i in ids)

    def chunk(self, chunk: str) -> tuple[str, str, int]:
        found = self.cache.get(chunk)
        if found is None:
            ids = self.encode(chunk)
            found = (" ".join(map(str, ids)), self.decode(ids), len(ids))
            if len(self.cache) >= CACHE:
                self.cache.clear()
            if len(chunk) < 64:
                self.cache[chunk] = found
        return found

    def encode_text(self, text: str) -> tuple[str, str, int]:
        """Decimal ids joined by a space, the decoded text and the number of ids."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split takes these for white space
            parts = [self.chunk(c) for c in self.space.split(text) if c]
        else:
            cache = self.cache
            parts = [cache.get(c) or self.chunk(c) for c in text.split()]
        parts = [p for p in parts if p[2]]
        return " ".join([p[0] for p in parts]), " ".join([p[1] for p in parts]), sum([p[2] for p in parts])


def load(path: str) -> WordBpe:
    """One encoder for each worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (decimal, joined by one space), decoded, n_tokens of each row of ``docs``.

    Null texts count as empty: no ids, empty strings.  Rows are independent;
    doc_ids may be null or repeat.  An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in slices(batches):
            ids, decoded, n = [list(x) for x in zip(*map(bpe.encode_text, texts(batch["text"])), strict=True)] or ([], [], [])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.string()), pa.array(decoded, pa.string()), pa.array(n, pa.int64())], ["doc_id", "ids", "decoded", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids string, decoded string, n_tokens long")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ``encode`` with its long columns hashed where they arise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in slices(batches):
            n, a, b = [], [], []
            for text in texts(batch["text"]):
                ids, decoded, count = bpe.encode_text(text)
                n.append(count)
                a.append(hashlib.sha256(ids.encode()).hexdigest())
                b.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
