"""Each stage of the pipeline against brute force on what the stage before kept."""

import collections
import random
import re
import zlib

import numpy as np
from test_operators import components_of, words

import corpus_pipeline
from larkspur.llm.workspace import stage


def without_passages(texts, window, words):
    """The texts without what ``window`` bytes or ``words`` words cover that occur elsewhere, and without halves of characters."""
    data = [(t or "").encode() for t in texts]
    spots = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in data]
    runs = [[b[x:y] for x, y in s] for b, s in zip(data, spots, strict=True)]
    seen = collections.Counter(b[j : j + window] for b in data for j in range(len(b) - window + 1))
    said = collections.Counter(tuple(r[j : j + words]) for r in runs for j in range(len(r) - words + 1))
    out = []
    for b, s, r in zip(data, spots, runs, strict=True):
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - window + 1):
            gone[j : j + window] |= seen[b[j : j + window]] > 1
        for j in range(len(r) - words + 1):
            gone[s[j][0] : s[j + words - 1][1]] |= said[tuple(r[j : j + words])] > 1
        out.append(bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore"))
    return out


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    texts = [words(rng, rng.randint(30, 120)) for _ in range(900)]
    texts = [t.replace(" ", " $$$ ") if i % 3 == 0 else t for i, t in enumerate(texts)]
    texts += texts[1:8] + [t + " more" for t in texts[20:30]] + [words(rng, 40) + " " + texts[31][:450], texts[33][:430] + words(rng, 30), None, "", "  "]
    rows = [(i, t, "en", f"s{i % 5}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 0 if i % 3 == 0 else 1, 0) for i in range(900) if i % 4]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, run in corpus_pipeline.STAGES:
        docs = stage(run(spark, docs, str(tmp_path)))
        kept.append(docs)
    now = [{r["doc_id"]: r["text"] for r in k.collect()} for k in kept[:4]]
    assert all(k.columns == ["doc_id", "text", "lang", "source", "n_chars"] for k in kept[:4])
    assert set(now[0]) == {i for i, t in enumerate(texts) if "$" not in (t or "")}
    best = {}
    for i, t in sorted(now[0].items()):
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        if norm not in best or len(t or "") > len(now[0][best[norm]] or ""):
            best[norm] = i
    assert set(now[1]) == set(best.values())
    ids = sorted(now[1])
    root, _ = components_of([now[1][i] for i in ids], 5, 80)
    assert set(now[2]) == {i for k, i in enumerate(ids) if root[k] == k}
    ids = sorted(now[2])
    rest = without_passages([now[2][i] for i in ids], 400, 51)
    assert now[3] == {i: now[2][i] if now[2][i] is None else t for i, t in zip(ids, rest, strict=True)} and now[3][31] == ""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    enc = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = {(i, zlib.crc32(np.array([*enc.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for i, t in now[3].items()}
    assert {(r["doc_id"], r["ids_crc32"]) for r in kept[4].collect()} == want
