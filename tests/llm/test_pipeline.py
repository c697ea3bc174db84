"""The pipeline over the smallest tables against brute force, stage by stage."""

from __future__ import annotations

import collections
import hashlib
import os
import re

import pytest

from .test_near_copies import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark):
    import public_tokenizers
    import sentencepiece

    import corpus_pipeline

    start = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs, kept = start, [rows_of(start)]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        kept.append(rows_of(docs))
        assert docs.count() == len(kept[-1])
    assert all(d.keys() <= kept[0].keys() for d in kept[1:])
    assert spark.read.parquet(f"{SF}/documents.parquet").columns == ["doc_id", "text", "lang", "source", "n_chars"]

    gone = kept[0].keys() - kept[1].keys()
    assert sum(labels.get(i) == 1 for i in gone) <= 1 and sum(labels.get(i) == 0 for i in kept[1]) <= 4
    assert all(kept[1][i] == kept[0][i] for i in kept[1])

    ids, nulls = brute([(i, r["text"]) for i, r in kept[1].items()])  # five-word Jaccard of 0.8
    assert sorted(map(str, kept[2])) == ids and nulls == 0
    assert all(kept[2][i] == kept[1][i] for i in kept[2])

    first: dict[bytes, int] = {}
    raw = {i: r["text"].encode() for i, r in kept[2].items()}
    for i in sorted(raw):
        for k in range(len(raw[i]) - 49):
            first.setdefault(raw[i][k : k + 50], i)
    for i, b in raw.items():
        cover = [False] * len(b)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                cover[k : k + 50] = [True] * 50
        text = bytes(x for x, c in zip(b, cover, strict=True) if not c).decode(errors="ignore")
        r = kept[3][i]
        assert (r["text"], r["n_chars"], r["lang"], r["source"]) == (text, len(text), kept[2][i]["lang"], kept[2][i]["source"])

    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows: dict[int, set] = collections.defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        if w := fold(r["text"]):
            n = min(10, len(w))
            windows[n] |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    clean = {i for i, r in kept[3].items() if not any(tuple(w[k : k + n]) in windows[n] for w in [fold(r["text"])] for n in windows for k in range(len(w) - n + 1))}
    assert kept[4].keys() == clean and all(kept[4][i] == kept[3][i] for i in clean)

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, r in kept[5].items():
        ids = sp.encode(kept[4][i]["text"])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert rows_of(corpus_pipeline.run(spark, SF)) == kept[5]
