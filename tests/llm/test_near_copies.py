"""The near-copy stage against brute-force Jaccard over five-word shingles."""

from __future__ import annotations

import random

from verity.llm import near_copies


def brute(rows):
    """Rows that stay, for distinct ids."""
    shingles = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        shingles.append({b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = shingles[a], shingles[b]
            if label[a] != label[b] and (len(x & y) >= 0.8 * len(x | y)):
                label = [label[b] if k == label[a] else k for k in label]
    low = {}
    for (i, _), k in zip(rows, label, strict=True):
        low[k] = min(low.get(k, (True, 0)), (i is None, i or 0))
    return sorted(str(i) for null, i in low.values() if not null), sum(null for null, _ in low.values())


def test_near_copies(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(900)]
    rows = [(900, ""), (901, None), (902, "one two"), (903, "One two"), (None, "one  two"), (None, "alone here"), (None, "Alone here")]
    for k in range(40):
        text = rng.choices(words, k=rng.randint(30, 300))
        for c in range(4):
            copy = list(text)
            for _ in range(rng.randint(0, len(text) // 30) if c else 0):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((k * 4 + (3 - c), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_copies.representatives(df).collect()
    ids, nulls = brute(rows)
    assert sorted(str(r["doc_id"]) for r in got if r["doc_id"] is not None) == ids
    assert sum(r["doc_id"] is None for r in got) == nulls == 1
    for bounds in ({"block": 2}, {"hashes": 100}):  # every band is cut into blocks
        small = near_copies.groups(df, **bounds).collect()
        assert len({r["group"] for r in small}) == len(ids) + nulls and len(small) == len(rows)


def partition_of(rows):
    """Groups of rows as sets of ids."""
    out = {}
    for r in rows:
        out.setdefault(r["group"], set()).add(r["doc_id"])
    return sorted(map(sorted, out.values()))


def test_band_with_several_components(spark):
    """One base that drifts: bands hold near copies beside texts that are alike but below 0.8, in every block size."""
    rng = random.Random(8)
    base, rows = [f"w{k}" for k in range(120)], []
    for k in range(90):
        text = list(base)
        for _ in range(k % 9):  # up to eight changed words: from equal to well below 0.8
            text[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = partition_of(near_copies.groups(df).collect())
    ids, _ = brute(rows)
    assert sorted(str(g[0]) for g in want) == ids and 1 < len(want) < 60
    for block in (1, 3, 10, 40):
        assert partition_of(near_copies.groups(df, block=block).collect()) == want


def test_known_component_is_met_only_by_the_others():
    import numpy as np

    near = [np.arange(100, dtype=np.uint64) + np.uint64(k) for k in (0, 2, 4)]
    far = [np.arange(500, 600, dtype=np.uint64), np.arange(501, 601, dtype=np.uint64)]
    one = np.arange(6, 106, dtype=np.uint64)
    assert near_copies.linked([*near, *far, one], 0.8).tolist() == [0, 0, 0, 3, 3, 0]
    assert near_copies.linked([*near, *far, one], 0.8, 3).tolist() == [0, 0, 0, 3, 4, 0]  # far ones meet elsewhere
    assert near_copies.linked(near, 0.8, 3).tolist() == [0, 0, 0]


def test_pipeline_stage_drops_pairs_beyond_three_bits(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted(str(r["doc_id"]) for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect())
    assert got == brute(rows)[0]
    assert "1" in got and "177" not in got and "145" not in got


def test_tries_over_two_words():
    """Links of roots over rows of two words against brute force, with and without linking neighbours first."""
    import numpy as np

    from verity.llm.simhash import trie_join

    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 64, (300, 2), np.uint64)
    flips = np.packbits(rng.random((150, 128)) < 0.08, axis=1).view(">u8").astype(np.uint64)
    values[:150] = values[rng.integers(0, 3, 150)] ^ flips
    root = (values[:, 0] >> np.uint64(62)).astype(np.int64)
    order = np.lexsort((values[:, 1], values[:, 0], root))
    root, values = root[order], values[order]
    near = (np.bitwise_count(values[:, None] ^ values[None]).sum(axis=2) <= 32) & (root[:, None] == root[None])
    want = np.arange(300)
    while not np.array_equal(low := np.where(near, want[None], 300).min(axis=1), want):
        want = low
    assert 10 < len(np.unique(want)) < 290
    for neighbours in (0, 4):
        for frontier in (16, 1 << 16):
            assert np.array_equal(trie_join(root, values, 32, frontier, neighbours).roots(), want)


def test_stage_names_candidates_by_simhash(spark):
    """Near copies share a band of the tries' roots, other texts none; a bit is the majority of a set's values."""
    import numpy as np

    rng = random.Random(5)
    raw = []
    for _ in range(60):
        text = [f"w{rng.randrange(3000)}" for _ in range(100)]
        raw += [" ".join(text).encode(), " ".join([*text[:-2], "p", "q"]).encode()]
    keys, sets, prints = near_copies.prints_of(raw, 5, 18)
    mixed = near_copies.mix(sets[7] + np.uint64(0x9E3779B97F4A7C15 * 3 & (1 << 64) - 1))
    assert int(prints[7, 1]) == sum(1 << b for b in range(64) if 2 * int((mixed >> np.uint64(b) & np.uint64(1)).sum()) > len(mixed))
    own = np.array(keys, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(k, bytearray(p.tobytes())) for k, p in zip(own, prints, strict=True)], "set long, print binary")
    for words, parts in ((18, 5), (18, 4), (18, 3)):
        bands = {}
        for r in near_copies.candidates(df, words, parts, 2000).collect():
            bands.setdefault(r["band"], set()).add(own.index(r["set"]))
        assert {tuple(sorted(b)) for b in bands.values()} == {(k, k + 1) for k in range(0, 120, 2)}


def test_texts_without_near_copies_are_not_dealt(spark):
    """What a run leaves in shuffle files: only texts that may have near copies, or may have to go, travel."""
    import os

    rng = random.Random(4)
    words = [f"w{k:06d}" for k in range(100_000)]
    rows = [(k, " ".join(rng.choices(words, k=1500))) for k in range(400)]
    rows += [(400 + k, f"{t} more") for k, t in rows[:4]] + [(1, rows[1][1]), (None, rows[2][1])]
    size = sum(len(t) for _, t in rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    root = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath()
    held = lambda: {p: os.path.getsize(p) for d, _, names in os.walk(root) for x in names if x.startswith("shuffle_") and os.path.exists(p := os.path.join(d, x))}
    old = held()
    got = near_copies.representatives(df).collect()
    made = sum(n for p, n in held().items() if p not in old)
    assert sorted(r["doc_id"] for r in got) == list(range(400))
    assert made < size / 4


def test_sieve_passes_every_key(spark):
    from pyspark.sql import functions as F

    from verity.llm.sieve import SEGMENT, sieve

    rows = spark.range(40_000).select((F.col("id") % 7 == 0).alias("null"), "id")
    keys = rows.where("id % 4 = 0")
    for most, other in ((1 << 26, 900), (SEGMENT, 6_000)):  # of 30,000 others; by calculation 1 %, and 7 % with 6.5 bits a key
        passed = rows.where(sieve(keys, ["null", "id"], most))
        assert passed.where("id % 4 = 0").count() == 10_000
        assert passed.where("id % 4 <> 0").count() < other
    assert rows.where(sieve(keys.where("false"), ["null", "id"])).isEmpty()
    assert rows.where(~sieve(keys.where("false"), ["null", "id"])).count() == 40_000
