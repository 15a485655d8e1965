"""Fill-in-middle, phrase collocations and packing in random groups against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from larkspur.llm import collocations, fill_middle, group_packing
from larkspur.llm.queries import QUERIES, word_bpe
from larkspur.llm.workspace import stage

SCHEMA = "doc_id long, text string, lang string, n long, row long, w1 string, words string, `group` long, h long, form string"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def rows_of(texts, langs=(None,)):
    return [(i, t, langs[i % len(langs)], 1, 2, "x", "y", 3, 4, "z") for i, t in enumerate(texts)]


def odd_texts():
    rng = random.Random(5)
    out = [None, "", " ", "\n\n", "one", " one", "one ", "é", "漢字 🙂 é́\x0b\x0c", "a" * 255, "a" * 256, "a" * 257, " " * 512, "x" + " " * 255 + "y", "\x85\xa0 b"]
    out += ["a <P> b", "<S>", "x<M>", "<<P>>", "<P", "< P>", "<P\n>", "P><S", "a" * 254 + "<P>", "a" * 255 + "<M>", "a" * 255 + " <P >", "b\x1cc\x1d d"]
    out += ["".join(rng.choice(["é", "a", " ", "\n", "<", "P", ">", "🙂", "\t"]) for _ in range(rng.randint(1, 700))) for _ in range(200)]
    return out + [" ".join(["wörd", "x"] * 60_000), "y" * 300_000, " " * 300_000] + ["same text here"] * 5


def brute_fim(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text, text
    p, q = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:p]), "".join(units[p:q]), "".join(units[q:])
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


@pytest.fixture(scope="module")
def texts():
    return odd_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts, ("en", "de", None)), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_fill_middle(spark, docs, empty, texts):
    rows = fill_middle.transform(docs)
    got = {r["doc_id"]: tuple(r)[1:] for r in rows.withColumn("back", fill_middle.restored(rows["output"], rows["form"])).collect()}
    want = {i: brute_fim(i, t) for i, t in enumerate(texts)}
    assert got == want
    assert {x[1] for x in want.values()} == {"plain", "psm", "spm"}
    assert fill_middle.transform(empty).count() == 0
    repeated = spark.createDataFrame([(None, "a b c"), (7, "a b"), (7, "a b"), (7, None)], "doc_id long, text string")
    assert sorted(map(str, (r["doc_id"] for r in fill_middle.transform(repeated).collect()))) == ["7", "7", "7", "None"]


@pytest.mark.parametrize("name", ["op11_fill_middle", "op12_pattern_growth", "op13_tournament_packing"])
def test_registered_on_odd_tables(spark, tmp_path, docs, empty, name):
    for part, df in (("odd", docs), ("empty", empty)):
        df.write.parquet(f"{tmp_path}/{part}/documents.parquet")
        out = QUERIES[name](spark, f"{tmp_path}/{part}")
        assert (out.count() == 0) == (part == "empty")


def brute_phrases(rows, least, longest, top, percent):
    f = collections.defaultdict(collections.Counter)
    total = collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({65 + k: 97 + k for k in range(26)})):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for s in range(1, longest + 1):
                for i in range(len(w) - s + 1):
                    f[lang][tuple(w[i : i + s])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        outer = collections.Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    outer[p[i : i + m]] = max(outer[p[i : i + m]], a)
        scored = []
        for p, a in found.items():
            if outer[p] and 100 * outer[p] >= percent * a:
                continue
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def phrase_rows():
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "gamma", "é", "Éa", "d\x01", "d", "x" * 80, "漢", "z\x85z"]
    rows = [(" ".join(rng.choices(vocabulary, [9, 5, 4, 3, 2, 2, 1, 1, 1, 1], k=rng.randint(0, 40))).replace("gamma alpha", "gamma, alpha"), rng.choice(["en", "en", "de", None])) for _ in range(160)]
    rows += [("New York City is big.\nnew york\tcity", "en")] * 15 + [("a a a a a", "en"), (None, "en"), ("", None), (" \t ", "de"), ("!?.", "xx"), ("alone", "xx")]
    return [*rows, ("of the " * 5000, "de")]


@pytest.mark.parametrize(("longest", "top"), [(3, 2000), (2, 7), (4, 30), (5, 2000)])
def test_collocations(spark, longest, top):
    rows = phrase_rows()
    docs = spark.createDataFrame([(i, *r, "extra", "phrase") for i, r in enumerate(rows)], "n long, text string, lang string, word string, phrase string").repartition(5)
    got = sorted(map(tuple, collocations.mine(docs, least=10, longest=longest, top=top).collect()))
    assert got == brute_phrases(rows, 10, longest, top, 50)
    assert len(got) > 20 or top < 30


def test_collocations_in_small_lots(spark, monkeypatch):
    """Pointers folded early, prefixes that fill whole batches, and bits that all collide."""
    rows = phrase_rows()
    words = collocations.word_counts(spark.createDataFrame([(lang or "und", t) for t, lang in rows], "lang string, text string"))
    frequent = words.filter("n >= 10")
    bits = collocations.bit_set(frequent)
    for r in frequent.collect():
        bit = collocations.slot(r["lang"], r["word"].encode())
        assert bits[bit >> 3] >> (bit & 7) & 1
    assert np.unpackbits(bits).sum() == frequent.count()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        texts = spark.createDataFrame([(lang or "und", t) for t, lang in rows], "lang string, text string").repartition(9)
        full = np.full_like(bits, 0xFF)
        got = {(r["lang"], tuple(r["words"])): r["a"] for r in collocations.patterns(collocations.pointers(texts, full, 3), 10, 3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    f = collections.Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({65 + k: 97 + k for k in range(26)})):
            w = re.findall(r"[^\x20\x09]+", piece)
            f.update((lang or "und", tuple(w[i : i + s])) for s in (2, 3) for i in range(len(w) - s + 1))
    assert got == {p: a for p, a in f.items() if a >= 10}


def test_scores_beyond_64_bits(spark):
    from larkspur.llm.workspace import Scratch

    a, left, right = 3_000_000_007, 3_000_000_019, 4_000_000_007
    found = spark.createDataFrame([("en", ["p", "q"], a)], "lang string, words array<string>, a long")
    words = spark.createDataFrame([("en", "p", left), ("en", "q", right)], "lang string, word string, n long")
    with Scratch(spark) as scratch:
        assert collocations.scored(found, words, scratch).first()["score"] == 1_000_000 * a * a // (left * right)


def test_first_fit_decreasing():
    rng = random.Random(8)
    for size, n in ((10, 40), (4096, 700), (64, 1), (7, 0)):
        lengths = [rng.randint(1, size) for _ in range(n)]
        bins: list[int] = []
        want = [None] * n
        for i in sorted(range(n), key=lambda i: -lengths[i]):
            b = next((b for b, used in enumerate(bins) if used + lengths[i] <= size), len(bins))
            if b == len(bins):
                bins.append(0)
            want[i] = (b, bins[b])
            bins[b] += lengths[i]
        place, rooms = group_packing.first_fit_decreasing(lengths, size)
        assert place == want and rooms == [size - used for used in bins]


def test_folded_chunks_are_encoded_as_the_library_does():
    rng = random.Random(3)
    parts = [*"abcABCxyzJK .,;:!?'\n\t|<>-_0123", "é", "É", "Σ", "ς", "İ", "ı", "J\u030c", "\u0301", "\u0307", "漢", "🙂", "\x85", "\xa0", "\x1c", "\u200b", "ẞ", "\u2126", "\u212a", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "I'LL", "x" * 70]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(4000)]
    encoder = group_packing.Encoder(word_bpe())
    for at in range(0, len(texts), 500):
        lot = texts[at : at + 500]
        want = [np.array(e.ids, "<u4").tobytes() for e in encoder.library.encode_batch(lot, add_special_tokens=False)]
        assert list(encoder.encode(lot)) == want


@pytest.mark.parametrize("group", [50, 4096])
def test_group_packing(spark, docs, empty, texts, group):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(word_bpe())
    library.no_truncation()
    library.no_padding()
    more = [*texts, "<|startoftext|> a<|endoftext|>b ENDOFTEXT", "ΟΔΟΣ Σ", "İx"] + ["repeated words of a row " * 30] * 400
    docs = spark.createDataFrame([*rows_of(more), (None, "null id", *rows_of([""])[0][2:]), (3, "again", *rows_of([""])[0][2:])], SCHEMA).repartition(4)
    docs = stage(docs)
    placed = group_packing.pack(docs, word_bpe(), group=group, filler=8)
    rows = placed.collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["row"]].append(r)
    kept = {r["row"]: (r["doc_id"], r["ids"]) for r in group_packing.encoded(docs, word_bpe()).collect()}
    want = collections.Counter()
    for i, t in [*enumerate(more), (None, "null id"), (3, "again")]:
        want[i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()] += 1
    assert collections.Counter((i, bytes(ids)) for i, ids in kept.values()) == want
    assert by.keys() == kept.keys()
    for row, parts in by.items():
        doc_id, ids = kept[row]
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert (r["doc_id"], r["start"], r["doc_tokens"]) == (doc_id, at, len(ids) // 4)
            assert r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert 4 * at == len(ids)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
        padding += 4096 - at if at & (at - 1) else 0
    groups = len({s >> 32 for s in sequences})
    assert padding < 4096 * groups and (groups == 1) == (group == 4096)
    assert groups > 1 or padding <= 0.01 * sum(len(i) // 4 for _, i in kept.values())
    packed = {r["sequence_id"]: r for r in group_packing.sequences(stage(group_packing.encoded(docs, word_bpe())), placed).collect()}
    assert packed.keys() == sequences.keys()
    assert all(len(packed[s]["ids"]) == 4 * sum(n for _, n in parts) for s, parts in sequences.items())
    assert group_packing.pack(empty, word_bpe()).count() == 0
