"""The training-data operators against brute force on hand-made documents."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import bpe, exact_dedup, fingerprints, line_dedup, minhash_dedup, packing, quality, suffix_dedup, url_filter, warc
from larkspur.llm.bytehash import shingle_set
from larkspur.llm.queries import byte_bpe, word_bpe

DOCS = "doc_id long, text string, source string, n_chars long, extra string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def corpus():
    rng = random.Random(7)
    base = [words(rng, rng.randint(5, 160)) for _ in range(40)]
    out = [None, "", "  \n\t", "one", "ONE", "x" * 5000, "Σίσυφος ΟΔΟΣ é 漢字 🙂", "<|endoftext|> a<|startoftext|>b", "tab\x1cfile\x1dgroup"]
    out += base + base[:6] + [b.replace(" ", "\n") for b in base[6:9]]
    long = words(rng, 2500)
    out += [long, long + " tail", words(rng, 80) + long[:900] + words(rng, 40)]
    out += [" ".join(w if i % 37 else "zz" for i, w in enumerate(long.split())) for _ in range(2)]
    return out


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, f"s{i % 7}", len(t or ""), "z") for i, t in enumerate(texts)], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_packing(docs, empty, texts):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    enc = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = sorted(packing.pack(docs, **byte_bpe()).collect(), key=lambda r: (r["doc_id"], r["piece"]))
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    total = 0
    for i, t in enumerate(texts):
        ids = np.array([*enc.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert [r["length"] for r in by[i]] == packing.cut_lengths(len(ids), 2048)
        for r in by[i]:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        total += len(ids)
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(seqs) <= -(-total // 2048) + 2
    assert packing.pack(empty, **byte_bpe()).count() == 0


def test_packing_of_very_long_runs(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = [" " * 1_000_000, "\n" * 1_000_000 + "x", "a" * 300_000, "x " + "\t" * 900_000 + "é"]
    docs = spark.createDataFrame([*enumerate(texts), (None, "n"), (None, "n"), (7, "r"), (7, None)], "doc_id long, text string")
    rows = packing.pack(docs, **byte_bpe()).collect()
    for i, t in enumerate(texts):
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 0], "<u4")
        own = [r for r in rows if r["doc_id"] == i]
        assert sum(r["length"] for r in own) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)
    assert sum(r["doc_id"] is None for r in rows) == 2 and sum(r["doc_id"] == 7 for r in rows) == 2


def test_most_pieces_are_packed_by_patterns():
    rng = np.random.default_rng(9)
    hist = np.bincount(rng.integers(1, 1025, 20_000), minlength=1025)
    found = packing.patterns(np.flatnonzero(hist), 1024)
    whole = packing.round_counts(packing.fit_counts(hist, found))
    used = sum(np.bincount(found[:, j], weights=whole, minlength=1025) for j in range(3))
    used[0] = 0
    assert np.minimum(used, hist).sum() > 0.8 * hist.sum()


def test_packed_sequences_hold_the_ids(docs):
    cut = packing.pieces(docs, **byte_bpe())
    placed = packing.pack(docs, **byte_bpe())
    got = packing.sequences(cut, placed).collect()
    assert sum(len(r["ids"]) for r in got) == 4 * placed.agg(F.sum("length")).first()[0]


@pytest.mark.parametrize("seed", range(3))
def test_plan_is_close_to_the_bound(seed):
    rng = np.random.default_rng(seed)
    hist = np.bincount(rng.integers(1, 257, 5000), minlength=257)
    rows, n = packing.plan(hist)
    fill = collections.Counter()
    for length, lo, hi, first, offset, per in rows.tolist():
        for k in range(hi - lo):
            fill[first + k // per] += length
            assert offset + (k % per + 1) * length <= 256
    assert len(fill) == n and max(fill.values()) <= 256 and sum(fill.values()) == int((hist * np.arange(257)).sum())
    assert n <= -(-sum(fill.values()) // 256) * 1.02 + 1


def naive_phrases(text):
    seen, start = set(), 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in seen:
            seen.add(text[start:end])
            start = end
    return seen


def test_fingerprints(docs, empty, texts):
    rows = {r["doc_id"]: r for r in fingerprints.compare_neighbours(docs).collect()}
    order = sorted(range(len(texts)), reverse=True)
    for k, i in enumerate(order):
        text, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        edited = fingerprints.edit(text, after)
        assert rows[i]["n_chars"] == len(text) and rows[i]["edited_sha256"] == sha(edited)
        assert rows[i]["fingerprint"] == fingerprints.fingerprint(text) and rows[i]["edited_fingerprint"] == fingerprints.fingerprint(edited)
        *_, (_, seen) = fingerprints.parse(text)
        assert seen == naive_phrases(text)
    assert fingerprints.compare_neighbours(empty).count() == 0
    a, b = naive_phrases(texts[-1]), naive_phrases(texts[-2])
    one, other = (fingerprints.from_text(fingerprints.fingerprint(t)) for t in texts[-2:])
    assert abs(fingerprints.likeness(one, other) - len(a & b) / len(a | b)) < 0.15


def test_fingerprints_are_hashed_by_slices(monkeypatch):
    """All texts of a slice are hashed and sorted together, and slices, repeated halos and buckets of one row change no fingerprint."""
    import pyarrow as pa

    rng = random.Random(21)
    own = ["", None, "a", "aa", "abab" * 300, "é\U0001F600" * 90, "", *("".join(rng.choice("abé") for _ in range(rng.randint(0, 300))) for _ in range(60))]
    rows = [(b, False, 10 * b + k, t) for b in range(7) for k, t in enumerate(own[10 * b : 10 * b + (1 if b == 3 else 10)])]
    firsts = {b: next(r for r in rows if r[0] == b) for b in range(7)}
    rows = sorted([*rows, *[(b, True, *firsts[(b + 1) % 7][2:]) for b in range(7) for _ in range(1 + b % 2)]], key=lambda r: r[:2])
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), pa.int64(), pa.string()), strict=True)], ["bucket", "halo", "doc_id", "text"])
    want = []
    for x, y in zip(rows, rows[1:], strict=False):
        if x[0] == y[0] and not x[1]:
            text, after = x[3] or "", y[3] or ""
            edited = fingerprints.edit(text, after)
            a, b, c = map(fingerprints.fingerprint, (text, edited, after))
            near = [fingerprints.likeness(fingerprints.from_text(a), fingerprints.from_text(z)) for z in (b, c)]
            want.append((x[2], len(text), sha(edited), a, b, *near))
    calls = []
    monkeypatch.setattr(fingerprints, "spans", lambda *x, f=fingerprints.spans: (calls.append(1), f(*x))[1])
    for step in (len(rows), 3, 1):
        calls.clear()
        out = fingerprints._compare(batch.slice(i, step) for i in range(0, len(rows), step))
        assert [tuple(r.values()) for b in out for r in b.to_pylist()] == want
        assert len(calls) <= -(-len(rows) // step)


def test_fingerprints_of_odd_rows(spark):
    odd = spark.createDataFrame([(None, "a"), (1, "bb"), (1, "bb"), (1, None)], "doc_id long, text string")
    assert fingerprints.compare_neighbours(odd).count() == 4
    assert fingerprints.compare_neighbours(spark.createDataFrame([(5, "abc")], "doc_id long, text string")).first()["near_next"] == 1.0


def test_bpe_is_the_librarys(docs, empty, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(word_bpe())
    rng = random.Random(1)
    hard = [*texts, "".join(rng.choice("abc") for _ in range(700)), "a" * 1000, "don't we'll  x's", "İstanbul ǅ ﬁ ½ ²", "é́"]
    own = bpe.load(word_bpe())
    for t in hard:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        got, decoded, n = own.encode_text(t or "")
        assert got == " ".join(map(str, ids)) and n == len(ids) and decoded == lib.decode(ids, skip_special_tokens=False)
    assert {r["doc_id"]: r["ids_sha256"] for r in bpe.digests(docs, word_bpe()).collect()}[3] == sha(" ".join(map(str, lib.encode("one", add_special_tokens=False).ids)))
    assert bpe.encode(empty, word_bpe()).count() == 0


def test_url_rules(spark):
    urls = ["http://A.Example.net/en/1", "https://x.net/a", "https://x.net", "http://shop.example.com/de/", "ftp://y.org/fr/z?q", "nothing", None, "http://example.org/en/", "http://notnet/x"]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[i]["rule"] for i in range(9)] == ["example.net/en/", "net/", None, "example.com/de/", "org/fr/", None, None, None, None]
    assert [got[i]["verdict"] for i in range(2)] == ["allow", "block"] and got[0]["host"] == "a.example.net" and got[6]["host"] == got[6]["path"] == ""
    assert all(r["verdict"] in ("allow", "block") for r in got.values())
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_trees_learn():
    rng = random.Random(3)
    rows = []
    for i in range(1200):
        bad = i % 2
        host = ("x%d" % rng.randrange(10**6) * 2 + ".zip") if bad else rng.choice(["news", "shop", "blog"]) + ".example.org"
        path = "/" + "/".join(words(rng, 1) for _ in range(rng.randint(1, 3))) + ("?a=1&b=2&c=%d" % rng.randrange(10**8) if bad else "")
        rows.append((f"http://{host}{path}", host, path.partition("?")[0], bad))
    u, h, p, y = zip(*rows, strict=True)
    model = url_filter.UrlModel().fit(u[:800], h[:800], p[:800], np.array(y[:800]))
    assert ((model.score(u[800:], h[800:], p[800:]) > 0) == np.array(y[800:], bool)).mean() > 0.97


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(3, "http://a/\r\nX: y", "same"), (1, None, "same"), (2, "u", None), (4, "v", ""), (5, "w", "é" * 70_000), (1, "zz", "other")], "page_id long, url string, html string")
    at = warc.write(pages, str(tmp_path / "w"))
    rows = {(r["page_id"], r["payload_bytes"]): r for r in warc.read(spark, at).collect()}
    assert len(rows) == 6 and rows[(3, 4)]["record_type"] == "revisit" and rows[(3, 4)]["refers_to"] == 1 and rows[(1, 4)]["record_type"] == "response"
    assert rows[(4, 0)]["refers_to"] == 2 and rows[(5, 140_000)]["html"] == "é" * 70_000
    import base64

    assert rows[(1, 4)]["payload_digest"] == base64.b32encode(hashlib.sha1(b"same").digest()).decode()
    assert spark.read.parquet(at.payloads).count() == 4
    small = warc.read(spark, warc.write(pages, str(tmp_path / "x"), least=5))
    assert small.filter("record_type = 'revisit'").count() == 0
    warc.export(spark, at, str(tmp_path / "files"))
    import gzip

    data = b"".join(gzip.open(f).read() for f in (tmp_path / "files").glob("*.gz"))
    assert data.count(b"WARC/1.1\r\n") == 6 and data.count(b"same\r\n\r\n") == 1
    assert rows[(3, 4)]["url"] == "http://a/\r\nX: y" and data.count(b"WARC-Date: ") == 6 and data.count(b"WARC-Profile: ") == data.count(b"WARC-Type: revisit") == 2
    back = sorted((bytes(r["header"]), bytes(r["payload"])) for r in warc.load(spark, str(tmp_path / "files")).collect())
    whole = sorted((bytes(r["header"]), bytes(r["payload"])) for r in warc.records(spark, at).collect())
    size = lambda head: re.sub(rb"Content-Length: \d+", b"", head)
    assert [(size(h), p if b"revisit" not in h else b"") for h, p in whole] == [(size(h), p) for h, p in back]
    assert warc.read(spark, warc.write(pages.limit(0), str(tmp_path / "y"))).count() == 0


def test_warc_of_repeated_rows(spark, tmp_path):
    rows = [(1, "u", "x"), (1, "u", "x"), (1, "v", "x"), (2, "u", "x"), (None, None, "y"), (None, None, "y"), (None, "q", None)]
    pages = spark.createDataFrame([(*r, "z", 5) for r in rows], "page_id long, url string, html string, sha256 string, kind int")
    got = [(r["page_id"], r["url"], r["record_type"], r["refers_to"]) for r in warc.read(spark, warc.write(pages, str(tmp_path / "r"))).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [
        (1, "u", "response", None), (1, "u", "revisit", 1), (1, "v", "revisit", 1), (2, "u", "revisit", 1),
        (None, None, "response", None), (None, None, "revisit", None), (None, "q", "response", None),
    ]))


def components_of(texts, k, percent):
    sets = [shingle_set((t or "").encode(), k) for t in texts]
    real = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(k, len(w))
        real.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
    assert [len(s) for s in sets] == [len(s) for s in real]
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(real):
        for j in range(i):
            b = real[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in real]


def test_near_duplicates(spark, docs, empty, texts):
    want, sizes = components_of(texts, 2, 80)
    rows = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(docs, 2).collect()}
    assert [rows[i]["component_id"] for i in range(len(texts))] == want and [rows[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert minhash_dedup.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "x y z"), (2, "x y z"), (9, "p q")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in minhash_dedup.near_duplicates(odd, 2).collect()) == [(0, 0), (1, 1), (1, 1), (2, 1), (9, 9)]


def test_exact_duplicates(spark, docs, empty, texts):
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append(i)
    want = {}
    for norm, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(texts[i] or ""), i))
        want |= {i: (keep, len(ids), i == keep, sha(norm)) for i in ids}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.deduplicate(docs).collect()}
    assert got == want
    assert sorted(r["doc_id"] for r in exact_dedup.drop_duplicates(docs).collect()) == sorted(i for i in want if want[i][2])
    assert exact_dedup.deduplicate(empty).count() == 0
    odd = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "ab"), (2, "q")], "doc_id long, text string")
    assert exact_dedup.deduplicate(odd).filter("kept").count() == 2 and exact_dedup.drop_duplicates(odd).count() == 2


def test_rice_code():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 1000):
        v = np.unique(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2))
        assert (exact_dedup.rice_decode(exact_dedup.rice_encode(v)) == v).all()


def cut(texts, window):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[j : j + window] for b in data for j in range(len(b) - window + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - window + 1):
            if seen[b[j : j + window]] > 1:
                gone[j : j + window] = True
        out.append((int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize(("window", "group_rows"), [(60, 16_384), (60, 1)])
def test_repeated_passages(docs, texts, window, group_rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_ROWS", group_rows)  # 1: every group takes the way of the hot ones
    keys = {(r["k1"], r["k2"]): r["doc_id"] for r in suffix_dedup.keyed(docs).select("doc_id", "k1", "k2").collect()}
    got = {keys[(r["k1"], r["k2"])]: (r["n_removed"], len(r["spans"]), bytes(r["rest"])) for r in suffix_dedup.cut_texts(docs, window).collect()}
    want = {i: c for i, c in enumerate(cut(texts, window)) if c[0]}
    assert got == want


@pytest.mark.parametrize("group_rows", [16_384, 1])
def test_repeated_passages_in_words(spark, group_rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_ROWS", group_rows)
    rng = random.Random(9)
    passage, short = words(rng, 51), words(rng, 50)
    assert len(passage) < 400
    own = [words(rng, 30) for _ in range(8)]
    texts = [f"{own[0]} {passage} {own[1]}", f"{own[2]}\n{passage}\té {own[3]}", f"{own[4]} {short} {own[5]}", f"{own[6]} {short} {own[7]}", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.remove_repeats(docs, words=51).collect()}
    assert got == {i: t.replace(passage, "") if t else t for i, t in enumerate(texts)}
    assert corpus_pipeline.repeated_passages(spark, docs, "").filter("doc_id = 0").first()["text"] == got[0]


@pytest.mark.parametrize("words_", [False, True])
def test_memory_of_sorted_groups(words_):
    """A task that sorts groups of anchors holds a few MB beside its rows, and finds the windows that repeat."""
    import tracemalloc

    import pyarrow as pa

    window = 51 if words_ else 400
    rng = np.random.default_rng(5)
    parts = [rng.integers(0, 1 << 62, 100, np.uint64).tobytes() if words_ else rng.integers(97, 122, 700, np.uint8).tobytes() for _ in range(4096)]
    parts[4000] = parts[9]
    anchor = np.arange(4096) // 8
    anchor[4000] = anchor[9]
    order = np.argsort(anchor, kind="stable")
    batch = pa.RecordBatch.from_arrays(
        [pa.array(order), pa.array(order), pa.array(anchor[order]), pa.array(np.full(4096, 300, np.int32)), pa.array(np.zeros(4096, np.int32)), pa.array([parts[i] for i in order], pa.binary())],
        ["k1", "k2", "anchor", "pos", "lo", "part"],
    )
    suffix_dedup.prefix(np.zeros(1, np.uint8))
    tracemalloc.start()
    out = [r for b in suffix_dedup._sort_groups(window, words_)([batch]) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted((r["k1"], r["start"], r["stop"]) for r in out) == [(9, 0, len(parts[9]) // (8 if words_ else 1)), (4000, 0, len(parts[9]) // (8 if words_ else 1))]
    assert peak < 30e6


def test_repeats_across_pieces_of_a_long_text(monkeypatch):
    """Anchors of a text are those of its pieces, and each window belongs to one."""
    data = np.random.default_rng(6).integers(97, 100, 5000, np.uint8)
    found = {}
    for piece in (1 << 22, 700):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        h, pos, lo, hi = suffix_dedup.anchors(data, 60)
        found[piece] = [(w, int(a), int(p)) for a, p, x, y in zip(h, pos, lo, hi, strict=True) for w in range(x, y + 1)]
        assert [w for w, _, _ in found[piece]] == list(range(len(data) - 59))
    assert found[700] == found[1 << 22]


def test_removal_keeps_columns(docs, empty, texts):
    rows = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs, 60).collect()}
    assert len(rows) == len(texts) and rows[0]["text"] is None and set(rows[0].asDict()) == {"doc_id", "text", "source", "n_chars", "extra"}
    for i, (_, _, rest) in enumerate(cut(texts, 60)):
        assert (rows[i]["text"] or "") == rest.decode("utf-8", "ignore") and (texts[i] is None or rows[i]["n_chars"] == len(rows[i]["text"]))
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_removal_keeps_replacement_characters(spark):
    rng = random.Random(10)
    passage = words(rng, 40)
    texts = [f"own \ufffd one é{passage}è tail \ufffd", f"other ê{passage}ë end"]
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 60).collect()}
    assert got == {i: cut(texts, 60)[i][2].decode("utf-8", "ignore") for i in (0, 1)}
    assert got[0].count("\ufffd") == 2


def test_lines(spark, empty):
    rows = [(i, f"own {i}\nshared\n\nrare" if i % 2 else f"own {i}\nshared", f"s{i}") for i in range(8)] + [(50, "rare\nrare", "s1"), (51, None, "s2"), (52, "shared", None), (53, "", "s3")]
    got = {r["doc_id"]: r for r in line_dedup.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), sites=5).collect()}
    assert got[1]["text"] == "own 1\n\nrare" and got[1]["n_removed"] == 1 and got[50]["n_removed"] == 0 and got[51]["text"] is None and got[51]["n_lines"] == 0
    assert got[52]["text"] == "" and got[53]["n_lines"] == 1
    assert line_dedup.remove_boilerplate(empty).count() == 0


def test_lines_of_long_texts_and_clashing_columns(spark):
    names = "doc_id long, text string, source string, t1 string, drop int, _drop int, copies int, n_lines string, h1 int"
    long = "\n".join(x for i in range(20_000) for x in (f"own {i}", "shared"))
    rows = [(i, f"shared\na{i}", f"s{i}", "k", i, 1, 2, "x", 3) for i in range(6)] + [(9, long, "s1", "k", 9, 1, 2, "x", 3), (9, long, None, "k", 10, 1, 2, "x", 3)]
    got = line_dedup.remove_boilerplate(spark.createDataFrame(rows, names), sites=5)
    assert got.columns == ["doc_id", "text", "source", "t1", "drop", "_drop", "copies", "h1", "n_lines", "n_removed"]
    rows = {r["drop"]: r for r in got.collect()}
    assert rows[0]["text"] == "a0" and rows[9]["n_removed"] == rows[10]["n_removed"] == 20_000 and rows[9]["n_lines"] == 40_000
    assert rows[9]["text"] == rows[10]["text"] == long.replace("\nshared", "")


def test_lines_in_shuffles_only(spark, monkeypatch):
    rows = [(i, f"own {i}\nshared\n\nrare", f"s{i}") for i in range(8)] + [(9, None, "s9"), (10, "", "s9"), (11, "shared", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(str, line_dedup.remove_boilerplate(docs, sites=5).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_PLACES", -1)
    assert sorted(map(str, line_dedup.remove_boilerplate(docs, sites=5).collect())) == want
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)
    monkeypatch.setattr(line_dedup, "BROADCAST_TEXTS", -1)
    assert sorted(map(str, line_dedup.remove_boilerplate(docs, sites=5).collect())) == want


def test_quality_on_held_out_labels(spark, empty):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 5 == 0
        text = words(rng, 60)
        rows.append((i, text.replace(" ", " | ") if bad else text))
        if i % 3:
            labels.append((i, 0 if bad else 1, 0))
    docs = spark.createDataFrame([*rows, (9000, None), (9001, "")], "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs, lab).collect()}
    unseen = [i for i in range(0, 1500, 3)]
    assert np.mean([kept[i] == (i % 5 != 0) for i in unseen]) > 0.99 and kept[9000] and kept[9001]
    assert quality.judge(docs, lab.limit(0)).filter("not kept").count() == 0
    assert quality.judge(empty, lab).count() == 0
    assert quality.keep_good(docs, lab).columns == ["doc_id", "text"]


def test_quality_adds_up_weak_evidence(spark):
    rng = random.Random(12)
    rows, labels, bad = [], [], set()
    for i in range(1600):
        text, lang = words(rng, 40).split(), ("aa", "bb")[i % 4 == 0]
        if i % 9 == 0:  # each of these words is in about 2 % of the documents
            bad.add(i)
            text[rng.randrange(40)] = f"vile{rng.randrange(5)}"
            text[rng.randrange(40)] = f"vile{rng.randrange(5)}"
        rows.append((i, " ".join(text), lang))
        if i % 5 < 3:
            labels.append((i, 1, int(i in bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    for lang in ("aa", "bb"):
        unseen = [i for i, _, own in rows if own == lang and i % 5 >= 3]
        assert np.mean([not got[i]["kept"] for i in unseen if i in bad]) > 0.8
        assert np.mean([not got[i]["kept"] for i in unseen if i not in bad]) < 0.03


def test_quality_ratios_have_both_signs(spark):
    docs = spark.createDataFrame([(i, "fine words" if i % 2 else "vile things") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    weight = {r["doc_id"]: r["log_weight"] for r in quality.judge(docs, labels).collect()}
    assert weight[399] > 0 > weight[398]


def finaliser(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
    return x ^ (x >> 31)


@pytest.mark.parametrize("temperature", [1.0, 0.25])
def test_quality_is_gumbel_top_k_of_the_ratio(spark, temperature):
    """Weights, noise and draw, each restated here."""
    rng = random.Random(13)
    texts = [words(rng, 30) + (" vile" if i % 6 == 0 else "") for i in range(600)] + ["", None]
    good = {i for i in range(500) if i % 6}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i in good), 0) for i in range(500)], "doc_id long, quality int, toxic int")
    chosen = {r["_id"] for r in quality.sample_labels(labels).filter("fit = 1").collect()}
    assert chosen < good and len(chosen) > 0.6 * len(good)
    sets = [set(quality.grams((t or "").encode()).tolist()) for t in texts]
    raw, target = collections.Counter(g for s in sets for g in s), collections.Counter(g for i in chosen for g in sets[i])
    share, ratio = len(chosen) / len(texts), {}
    for g, n in raw.items():
        z4 = ((n * share - target[g]) ** 2 / (n * share + 1)) ** 2
        ratio[g] = math.log((target[g] + quality.PRIOR) / (n * share + quality.PRIOR)) * z4 / (z4 + quality.DOUBT**2)
    weight = [sum(ratio[g] for g in s) for s in sets]
    key = []
    for i, t in enumerate(texts):
        u = (finaliser(i ^ finaliser(len((t or "").encode()))) >> 11) / 2**53
        key.append(weight[i] / temperature - math.log(-math.log(u + 2.0**-54)))
    best = sorted(range(len(texts)), key=lambda i: -key[i])[:400]
    rows = {r["doc_id"]: r for r in quality.judge(docs, labels, k=400, temperature=temperature).collect()}
    assert all(abs(rows[i]["log_weight"] - weight[i]) < 1e-3 for i in rows)
    assert {i for i in rows if rows[i]["kept"]} == set(best)


def test_no_stage_loses_columns_that_its_own_names_clash_with(spark):
    names = [*"hnrd", "_h", "_n", "_s", "_key", "_weight", "_lang", "_id", "rest", "id", "digest", "key", "weight", "tongue", "cut", "k1", "k2", "ranges", "clean", "spans", "kept", "log_weight", "a.b"]
    rng = random.Random(14)
    passage = words(rng, 120)
    texts = [words(rng, 40), words(rng, 40) + " " + passage, passage + " " + words(rng, 40), None, "", words(rng, 9)]
    rows = [(i, t, *[f"{c}{i}" for c in names]) for i, t in enumerate([*texts, texts[0]])]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *[f"`{c}` string" for c in names]]))
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    for run in (lambda d: quality.keep_good(d, labels), exact_dedup.drop_duplicates, minhash_dedup.drop_near_duplicates, suffix_dedup.remove_repeats):
        got = run(docs)
        assert got.columns == docs.columns
        assert all(r[c] == f"{c}{r['doc_id']}" for r in got.collect() for c in names)
        assert run(docs.limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in exact_dedup.drop_duplicates(docs).collect()) == [0, 1, 2, 3, 5]
    cut = {r["doc_id"]: r["text"] for r in suffix_dedup.remove_repeats(docs).collect()}
    assert cut[1] == texts[1].replace(passage, "").rstrip() + " " and cut[2].strip() == texts[2].replace(passage, "").strip() and cut[3] is None


def test_kth_largest(spark):
    vals = [random.Random(2).randint(-(1 << 62), 1 << 62) for _ in range(300)] + [-5, -5, 0, 7]
    frame = spark.createDataFrame([(v,) for v in vals], "key long")
    for k in (1, 17, 304):
        assert quality.kth_largest(frame, k) == sorted(vals, reverse=True)[k - 1]
