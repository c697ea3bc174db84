"""Ordinary and odd tables on which nothing repeats: no operator may stumble over a block without a match."""

from __future__ import annotations

import hashlib
import random

import pytest

from verity.llm import blocks, lm_scoring, rlz_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string"
TABLES = {
    "unique words": [(i, " ".join(f"w{i}x{k}" for k in range(100)), "en") for i in range(5)],
    "short texts": [(i, t, "en") for i, t in enumerate(["a", "b c", "ab", "x", "y z"])],
    "null, empty and blank": [(1, None, "en"), (2, "", "en"), (3, " \n", None), (None, None, None)],
    "one document": [(1, "only one document " * 30, "en")],
    "many without repeats": [(i, " ".join(random.Random(i).choice("abcdefgh") * 3 + str(i * 1000 + k) for k in range(60)), "en") for i in range(200)],
    "largest and smallest ids": [(2**63 - 1, "x y z", "en"), (-(2**63), "x y z", "en"), (None, "x y z", "en")],
}


@pytest.fixture(params=sorted(TABLES))
def table(request, spark):
    rows = TABLES[request.param]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.fixture()
def small_blocks(monkeypatch):
    for module in (lm_scoring, rlz_dedup, suffix_dedup):
        monkeypatch.setattr(module, "deal", lambda *a, f=blocks.deal, **k: f(*a[:3], 4000, **k))


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def test_nothing_repeats(table, small_blocks):
    rows, df = table
    want = order((i, len((t or "").split()), 0, hashlib.sha256(" ".join((t or "").split()).encode()).hexdigest()) for i, t, _ in rows)
    assert order(tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in rlz_dedup.parse(df).collect()) == want
    want = order((i, len((t or "").encode()), 0, 0, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows)
    assert order(tuple(r) for r in suffix_dedup.remove_repeats(df).collect()) == want
    assert order((r["doc_id"], r["n_tokens"]) for r in lm_scoring.score(df).collect()) == order((i, len((t or "").split()) + 1) for i, t, _ in rows)


def test_stage_keeps_rows_without_repeats(table, small_blocks):
    rows, df = table
    assert order(tuple(r) for r in suffix_dedup.without_repeats(df).collect()) == order((i, t or "", x) for i, t, x in rows)


ODD = "doc_id long, text string, `a.b` string, `a b-c` int, `row` string, rank int, block int, kept_id long, d long, h long, n_chars int"


def odd_rows():
    prose = " ".join(random.Random(4).choice(["river", "stone", "wall", "the", "of"]) + str(k % 13) for k in range(80))
    more = [" ".join(random.Random(s).choice("abcdefghij") * 2 + str(random.Random(s * k).randrange(99)) for k in range(60)) for s in (7, 8)]
    texts = [(1, prose), (2, prose), (1, more[0]), (1, more[1]), (3, None), (4, ""), (5, " \n\t"), (None, prose), (None, None), (None, "short"), (6, "x" * 300), (6, "x" * 300), (7, prose * 40), (8, "last one, with ünïcode é" * 9), (9, "")]
    return [(i, t, "q", k, "r", k, 3, 4, 5, 6, len(t or "")) for k, (i, t) in enumerate(texts)]


def stages(spark):
    from verity.llm import decontamination, near_copies, quality, sentencepiece_rounds

    public = pytest.importorskip("public_tokenizers")
    bench = spark.createDataFrame([(1, "stone wall"), (2, None), (None, "x")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 0, 0), (3, None, 0), (None, 0, 0)], "doc_id long, quality int, `a.b` int")
    from pyspark.sql import functions as F

    return {
        "quality": lambda d: quality.keep_good(d, quality.fit(d, labels, F.lit(True))),
        "near_copies": near_copies.representatives,
        "repeats": suffix_dedup.without_repeats,
        "leaks": lambda d: decontamination.clean(d, bench),
        "encode": lambda d: sentencepiece_rounds.encode_documents(d, public.path("piece_bpe_32k.model")),
    }


@pytest.mark.parametrize("stage", ["quality", "near_copies", "repeats", "leaks", "encode"])
def test_stages_on_odd_tables(spark, stage, small_blocks):
    """Nulls in any column, empty texts, repeated ids and rows, columns whose names clash or need quoting; no rows."""
    rows = odd_rows()
    df = spark.createDataFrame(rows, ODD)
    run = stages(spark)[stage]
    got = run(df)
    assert run(df.where("false")).collect() == []
    if stage == "encode":
        assert got.count() == len(rows)
        return
    assert got.dtypes == df.dtypes
    kept = [tuple(r) for r in got.collect()]
    if stage == "near_copies":  # of near copies the row with the smallest id; other texts of an id stay
        texts = sorted(t or "" for _, t, *_ in kept)
        assert texts == sorted(["", *{t for _, t, *_ in rows if t and t.strip()}]) and {i for i, t, *_ in kept if t == rows[0][1]} == {1}
        assert [i for i, t, *_ in kept if not (t or "").strip()] == [3]
        assert all(r in rows for r in kept)
    elif stage == "repeats":
        assert len(kept) == len(rows) and sorted(r[3] for r in kept) == list(range(len(rows)))
        for r in kept:
            old = rows[r[3]]
            assert (r[0], r[2], *r[4:10]) == (old[0], old[2], *old[4:10]) and r[10] == len(r[1]) and len(r[1]) <= len(old[1] or "")
        assert [r[1] for r in sorted(kept, key=lambda r: r[3])][:1] == [rows[0][1]] and next(r[1] for r in kept if r[3] == 1) == ""
    elif stage == "leaks":
        import re

        hit = {k for k, r in enumerate(rows) if "stone wall" in " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r[1] or "").lower()))}
        assert sorted(r[3] for r in kept) == [k for k in range(len(rows)) if k not in hit]
    else:
        assert all(r in rows for r in kept)


def test_queries_on_odd_tables(spark, small_blocks):
    """Every operator gives each row of such a table one row, and none of an empty one."""
    from pyspark.sql import functions as F

    from verity.llm import decontamination, language, quality, sentencepiece_rounds, simhash

    public = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame(odd_rows(), ODD)
    labels = spark.createDataFrame([(1, 1), (6, 0)], "doc_id long, quality int")
    model = quality.fit(df, labels, F.lit(True))
    langs = language.fit(df.withColumn("lang", F.lit("en")), F.lit(True))
    every = {
        "op1": lm_scoring.score, "op2": rlz_dedup.parse, "op4": lambda d: language.identify(d, langs), "op5": simhash.simhash_components, "op6": suffix_dedup.remove_repeats,
        "op7": lambda d: decontamination.contamination(d, df.select(F.col("doc_id").alias("item_id"), "text")),
        "op8": lambda d: sentencepiece_rounds.encode_documents(d, public.path("piece_bpe_32k.model")), "op10": lambda d: quality.score(d, model),
    }
    want = sorted(str(r[0]) for r in odd_rows())
    for name, run in every.items():
        assert sorted(str(r["doc_id"]) for r in run(df).collect()) == want, name
    for name in ("op5", "op7", "op8"):
        assert every[name](df.where("false")).collect() == [], name
