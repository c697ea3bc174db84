"""Each operator against a plain brute-force version, on small fixtures with nulls, ties, repeats and odd texts."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from verity.llm import decontamination, exchange, language, lm_scoring, multi_index, quality, rlz_dedup, sentencepiece_rounds, simhash, suffix_dedup, token_files
from verity.llm.components import Forest, components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, bucket int, hash long, words string"


def corpus(seed: int = 3, n: int = 90) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["the", "of", "And", "é", "ß,", "naïve", "x|", *("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(300))]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    texts: list = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 160))]
        if i % 4 == 1:
            k = rng.randint(0, len(words))
            words[k:k] = passage[rng.randint(0, 8) :]
        if i % 6 == 2 and texts and texts[-1]:
            words = texts[-1].split()
            if words and i % 12 == 2:
                words[rng.randrange(len(words))] = "changed"
        texts.append(rng.choice([" ", "  ", "\n"]).join(words))
    texts += ["", None, " ", "a" * 400, "a" * 300, "word " * 200, "word " * 180, texts[5], "é" * 90, "<|endoftext|> ▁ x  y", "ABC \x0b\x0c tab\tend\r\n"]
    ids = [*range(len(texts)), 7, 7, None, None]
    texts += [texts[7], texts[9], texts[5], texts[5]]
    rng.shuffle(order := list(range(len(ids))))
    return [(ids[i], texts[i], "en", "s", 1, 5, 6, 7, "w") for i in order]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def empty(docs):
    return docs[1].where("false")


def key(i):
    return 2**63 - 1 if i is None else i


def listed(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


def expect(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


@pytest.fixture()
def many_blocks(monkeypatch):
    """Blocks of about 4 kB, so that a small corpus has many."""
    from verity.llm import blocks

    for module in (lm_scoring, rlz_dedup, suffix_dedup):
        monkeypatch.setattr(module, "deal", lambda *a, f=blocks.deal, **k: f(*a[:3], 4000, **k))


class Arcs:
    """The automaton by dictionaries: arcs (history, word) and failure arcs, walked one token after the other."""

    def __init__(self, tokens, order, strength):
        self.order, self.strength = order, strength
        self.count = collections.Counter()
        for t in tokens:
            for k in range(1, order + 1):
                padded = ["start", *t]
                self.count.update(tuple(padded[i : i + k]) for i in range(0 if k > 1 else 1, len(padded) - k + 1))
        self.start = len(tokens)
        self.total = sum(c for g, c in self.count.items() if len(g) == 1)
        self.kinds = sum(len(g) == 1 for g in self.count)

    def seen(self, history):
        return self.start if history == ("start",) else self.count[history]

    def p(self, history, word):
        if not history:
            return (self.count[(word,)] + 0.1) / (self.total + 0.1 * (self.kinds + 1))
        k = self.strength[len(history)]
        return (self.count[(*history, word)] + k * self.p(history[1:], word)) / (self.seen(history) + k)

    def walk(self, text):
        state, score, fails = ("start",)[: self.order - 1], 0.0, 0
        for w in text:
            while state and not self.count[(*state, w)]:
                k = self.strength[len(state)]
                score, state, fails = score + math.log10(k / (self.seen(state) + k)), state[1:], fails + 1
            score += math.log10(self.p(state, w))
            state = (*state, w)[-(self.order - 1) :] if self.order > 1 else ()
            while state and not self.seen(state):
                state = state[1:]
        return score, fails


@pytest.mark.parametrize(("order", "fan"), [(1, 8), (2, 8), (3, 3)])
def test_lm_scoring(docs, many_blocks, monkeypatch, order, fan):
    rows, df = docs
    used = []
    monkeypatch.setattr(lm_scoring, "strengths", lambda *a, f=lm_scoring.strengths: used.append(f(*a)) or used[-1])
    got = listed(lm_scoring.score(df, order=order, fan_bits=fan), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    tokens = [[*(t or "").encode().lower().split(), None] for _, t, *_ in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows]
    arcs = Arcs([t for t, h in zip(tokens, held, strict=True) if not h], order, used[-1])
    for k in range(1, order):  # Good and Turing's condition on each strength
        expected = sum(c * used[-1][k] / (c + used[-1][k]) for g, c in arcs.count.items() if len(g) == k)
        assert expected == pytest.approx(sum(c == 1 for g, c in arcs.count.items() if len(g) == k + 1), rel=1e-3)
    want = []
    for (i, *_), t, h in zip(rows, tokens, held, strict=True):
        base = sum(math.log10(arcs.p((), w)) for w in t)
        want.append((i, h, len(t), sum(arcs.count[(w,)] > 0 for w in t), arcs.total, base, arcs.walk(t)[0]))
    want = expect(want)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)
    assert lm_scoring.score(empty(docs)).collect() == []


def test_automaton_arcs_and_failures():
    """States, arcs and failure arcs of a small block against dictionaries, and that a state's weights sum to one."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 30))) for _ in range(40)] + ["a b zzz q a b"]
    import pyarrow as pa

    from verity.llm.blocks import packed

    batch = pa.record_batch({"block": pa.array([0] * 41, pa.int32()), "doc_id": pa.array(range(41), pa.int64()), "text": texts})
    import zstandard

    block = packed([batch], zstandard.ZstdCompressor())
    g = lm_scoring.Grams.of(pa.Table.from_batches([block]), 3, 3, 0)
    tokens = [[*t.encode().split(), None] for t in texts]
    strength = [1.0, 2.0, 3.0]
    arcs = Arcs([t for i, t in enumerate(tokens) if zlib.crc32(str(i).encode()) % 3], 3, strength)
    model = lm_scoring.Automaton(g, g.train, arcs.total, arcs.kinds, arcs.start, strength)
    flat = [(d, i) for d, t in enumerate(tokens) for i in range(len(t))]
    name = {}
    for k in range(3):
        for (d, i), x in zip(flat, g.gram[k].tolist(), strict=True):
            if x >= 0:
                name[x] = tuple(["start", *tokens[d]][i + 1 - k : i + 2])
    assert len(name) == len(g.key) > len(arcs.count) and set(arcs.count) <= set(name.values())
    for x, words in name.items():
        assert g.train[x] == arcs.count[words] and g.order[x] == len(words)
        assert 10 ** model.weight[x] == pytest.approx(arcs.p(words[:-1], words[-1]))
        assert model.fail[x + 2] == (0 if len(words) == 1 else 2 + next(y for y, w in name.items() if w == words[1:]))
        if len(words) < 3 and words[-1] is not None:
            k = strength[len(words)]
            assert 10 ** model.fail_weight[x + 2] == pytest.approx(k / (arcs.seen(words) + k))
    for history in [("start",), (b"a",), (b"a", b"b"), ("start", b"a")]:
        words = [w for (w,) in [g for g in arcs.count if len(g) == 1]]
        unknown = 0.1 / (arcs.total + 0.1 * (arcs.kinds + 1))
        for n in range(len(history)):
            k = strength[n + 1]
            unknown *= k / (arcs.seen(history[len(history) - 1 - n :]) + k)
        assert sum(arcs.p(history, w) for w in words) + unknown == pytest.approx(1)
    assert np.allclose(model.traverse(), [arcs.walk(t)[0] for t in tokens])
    assert sum(arcs.walk(t)[1] for t in tokens) > 2


def test_exchange_messages_grow_with_the_blocks(spark):
    """Every key's sum comes back to every asker through any number of levels, with at most blocks * fan messages each."""
    import pyarrow as pa
    from pyspark.sql import types as T

    rng = np.random.default_rng(3)
    requests = []
    for _ in range(70):
        key = np.unique(rng.integers(0, 2**64, rng.integers(1, 60), dtype=np.uint64))
        requests.append((np.unique(np.append(key, np.uint64(7))), None))
    requests = [(k, rng.integers(0, 300, len(k))) for k, _ in requests]
    total = collections.Counter()
    for k, v in requests:
        total.update(dict(zip(k.tolist(), v.tolist(), strict=True)))
    kind = exchange.Counts()
    for fan in (2, 3, 8):
        sent = [r for i, q in enumerate(requests) for r in exchange.messages(kind, q, i, len(requests), fan).to_pylist()]
        assert len(sent) <= len(requests) << fan
        asked = spark.createDataFrame([tuple(r.values()) for r in sent], T.StructType.fromDDL(exchange.ROW))
        back = collections.defaultdict(list)
        for r in exchange.answers(asked, kind, len(requests), fan).collect():
            back[r["node"]].append(r)
        for i, (k, _) in enumerate(requests):
            t = pa.Table.from_pylist([r.asDict() for r in back[i]])
            t = t.set_column(t.column_names.index("data"), "data", pa.array([bytes(x) for x in t.column("data").to_pylist()]))
            assert exchange.joined(kind, t).tolist() == [total[x] for x in k.tolist()]


def test_gram_messages():
    """n-grams of a block come back as they were, in two thirds of the bytes that plain counts take."""
    rng = np.random.default_rng(4)
    for bits in (10, 49, 61):
        kind = lm_scoring.GramCounts(None, bits)
        for n in (1, 2, 500, 20_000):
            hashed = rng.integers(0, 1 << bits, n, np.uint64)
            if n > 2:
                hashed[:40] = hashed[40:80]  # the same hash in several orders
            key = np.unique((hashed << np.uint64(3) | rng.choice(np.array([0, 1, 2, 2, 2, 7], np.uint64), n)) << np.uint64(61 - bits))
            value = rng.choice(np.array([0, 1, 1, 1, 1, 1, 2, 30, 31, 255, 10**12], np.int64), len(key), p=[0.1, *[0.174] * 5, 0.02, *[0.0025] * 4])
            back = kind.unpack(kind.pack((key, value)))
            assert (back[0] == key).all() and (back[1] == value).all() and back[1].dtype == np.int64
    key = np.unique((rng.integers(0, 1 << 49, 1_000_000, np.uint64) << np.uint64(3) | rng.integers(0, 3, 1_000_000, np.uint64)) << np.uint64(12))
    request = key, np.ones(len(key), np.int64)
    kind = lm_scoring.GramCounts(None, 49)
    sent = lambda how: sum(len(how.pack(part)) for _, part in how.split(request, 8, 0))
    assert sent(kind) < 0.72 * sent(exchange.Counts()) and sent(kind) < 4.3 * len(key)


def brute_spans(items, length):
    first: dict = {}
    for i, s in items:
        for k in range(len(s) - length + 1):
            w = tuple(s[k : k + length]) if isinstance(s, list) else s[k : k + length]
            first[w] = min(first.get(w, key(None)), key(i))
    for i, s in items:
        cover = [False] * len(s)
        for k in range(len(s) - length + 1):
            w = tuple(s[k : k + length]) if isinstance(s, list) else s[k : k + length]
            if first[w] < key(i):
                cover[k : k + length] = [True] * length
        yield cover


def test_rlz_dedup(docs, many_blocks):
    rows, df = docs
    items = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    want = []
    for (i, w), cover in zip(items, brute_spans(items, 50), strict=True):
        kept = b" ".join(x for x, c in zip(w, cover, strict=True) if not c)
        want.append((i, len(w), sum(cover), hashlib.sha256(kept).hexdigest()))
    assert sum(r[2] for r in want) > 1000
    assert listed(rlz_dedup.parse(df, hot=4), "doc_id", "n_words", "n_removed", "kept_sha256") == expect(want)
    assert rlz_dedup.parse(empty(docs)).collect() == []


def test_rlz_factors(docs, many_blocks):
    """Each factor is copied from its source word for word, is as long as it can be there, and all repeats are covered."""
    rows, df = docs
    words = collections.defaultdict(list)
    for i, t, *_ in rows:
        words[i].append((t or "").encode().split())
    first: dict = {}
    for i, each in words.items():
        for w in each:
            for k in range(len(w) - 49):
                first[tuple(w[k : k + 50])] = min(first.get(tuple(w[k : k + 50]), (key(None), 0)), (key(i), k))
    got, seen = rlz_dedup.parse(df, keep_text=True, fan_bits=3).collect(), 0
    for r in got:
        if len(words[r["doc_id"]]) > 1:
            continue
        (own,), spans, starts = words[r["doc_id"]], r["factors"], []
        for f in spans:
            seen += 1
            assert f["source"] < key(r["doc_id"]) and f["words"] >= 50
            piece = own[f["start"] : f["start"] + f["words"]]
            assert any(w[f["source_start"] : f["source_start"] + f["words"]] == piece for w in words[f["source"]])
            for k in range(f["words"] - 49):  # the reference is the smallest document that has the phrase
                assert first[tuple(piece[k : k + 50])][0] == f["source"]
                starts.append(f["start"] + k)
        assert starts == [k for k in range(len(own) - 49) if first[tuple(own[k : k + 50])][0] < key(r["doc_id"])]
        for f, g in zip(spans, spans[1:], strict=False):  # a factor ends only where its source does not go on
            assert f["start"] + f["words"] - 49 < g["start"] or (f["source"], f["source_start"] + g["start"] - f["start"]) != (g["source"], g["source_start"])
    assert seen > 40


def test_rlz_compares_words(monkeypatch):
    """Phrases that share a hash are told apart by their words."""
    from verity.llm.passages import NONE, Passages

    rng = random.Random(6)
    parts = [b" ".join(rng.choice([b"a", b"bb", b"c"]) for _ in range(rng.randint(4, 12))) for _ in range(40)]
    windows = np.array([len(x.split()) - 2 for x in parts])
    p = Passages(np.zeros(40, np.uint64), parts, windows, np.array([rng.randint(0, 9) for _ in parts]), np.array([rng.randint(0, 99) for _ in parts]))
    good = rlz_dedup.first_places(p, 3)
    exact = rlz_dedup.first_places_by_words(p, 3)
    assert [x.tolist() for x in good] == [x.tolist() for x in exact] and 0 < (good[0] != NONE).sum() < len(good[0])
    monkeypatch.setattr(rlz_dedup, "ranges", lambda pre, a, b, f=rlz_dedup.ranges: f(pre, a, b) % np.uint64(5))
    assert [x.tolist() for x in rlz_dedup.first_places(p, 3)] == [x.tolist() for x in exact]


def test_suffix_dedup(docs, many_blocks):
    rows, df = docs
    items = [(i, (t or "").encode()) for i, t, *_ in rows]
    want = []
    for (i, b), cover in zip(items, brute_spans(items, 50), strict=True):
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        spans = sum(c and not p for p, c in zip([False, *cover], cover, strict=False))
        want.append((i, len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    assert sum(r[2] for r in want) > 5000
    assert listed(suffix_dedup.remove_repeats(df, hot=4, fan_bits=3), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expect(want)
    assert suffix_dedup.remove_repeats(empty(docs)).collect() == []


def test_previous_factors_against_a_scan():
    rng = np.random.default_rng(1)
    for _ in range(30):
        data = rng.integers(0, 2, 300).astype(np.uint8)
        doc = np.repeat(rng.integers(0, 5, 30), 10)
        at = np.arange(290)
        order, common = suffix_dedup.suffix_order(data, at, 10)
        assert [bytes(data[a : a + 10]) for a in order] == sorted(bytes(data[a : a + 10]) for a in at)
        d = doc[at][order]
        got = suffix_dedup.previous_factors(d, common, 6)
        for k in range(len(d)):
            best = 0
            for side in (range(k - 1, -1, -1), range(k + 1, len(d))):
                low = 10
                for j in side:
                    low = min(low, common[max(j, k) if j < k else j] if j > k else common[j + 1])
                    if low < 6:
                        break
                    if d[j] < d[k]:
                        best = max(best, low)
                        break
            assert got[k] == best


def test_simhash(docs):
    rows, df = docs
    prints = []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        votes = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
        prints.append((i, sum(1 << b for b in range(64) if votes[b] * 2 > len(shingles))))
    want = [(i, f"{f:016x}", c) for (i, f), c in zip(prints, brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 3), strict=True)]
    assert listed(simhash.simhash_components(df, rows_per_partition=20), "doc_id", "fingerprint", "component_id") == expect(want)
    assert simhash.simhash_components(empty(docs)).collect() == []


def brute_components(items, linked):
    label = list(range(len(items)))
    for a in range(len(items)):
        for b in range(a):
            if linked(items[a][1], items[b][1]) and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least: dict = {}
    for (i, _), k in zip(items, label, strict=True):
        least[k] = min(least.get(k, key(None)), key(i))
    return [None if least[k] == key(None) else least[k] for k in label]


def test_trie_join_finds_all_links():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    flips = [base]
    for _ in range(5):
        x = base.copy()
        for _ in range(int(rng.integers(1, 5))):
            x ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
        flips.append(x)
    values = np.unique(np.concatenate(flips))
    forest = simhash.trie_join(np.zeros(len(values), np.int64), values, 3, frontier=64)
    want = brute_components(list(enumerate(values.tolist())), lambda a, b: (a ^ b).bit_count() <= 3)
    assert forest.roots().tolist() == want


def test_components(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(500, 500 + k) for k in range(1, 50)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    forest = Forest(600)
    forest.union(*np.array(links).T)
    roots = forest.roots()
    assert got == {i: int(roots[i]) for e in links if e[0] != e[1] for i in e}


def test_multi_index(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    rows, i = [], 0
    for b in base:
        for _ in range(int(rng.integers(1, 5))):
            rows.append((i, [float(x) for x in (b + rng.normal(size=16) * 0.12).astype(np.float32)], 1, 2, 3))
            i += 1
    rows += [(i, rows[0][1], 1, 2, 3), (i + 1, [2 * x for x in rows[0][1]], 1, 2, 3), (i + 2, None, 1, 2, 3), (i + 3, [0.0] * 16, 1, 2, 3), (i + 4, [float("nan")] * 16, 1, 2, 3), (i + 5, [None] * 16, 1, 2, 3), (i + 6, [1.0, 2.0], 1, 2, 3), (None, rows[0][1], 1, 2, 3)]
    rows += [(i + 10 + k, rows[3][1], 1, 2, 3) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int, rep int, v int")
    usable = [r for r in rows if r[0] is not None and r[1] and len(r[1]) == 16 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    x = np.array([r[1] for r in usable])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    part = brute_components([(r[0], k) for k, r in enumerate(usable)], lambda a, b: near[a, b])
    links = {r[0]: (int(near[k].sum()) - 1, part[k]) for k, r in enumerate(usable)}
    want = [(r[0], *links.get(r[0], (0, r[0])), r[0] is None or links.get(r[0], (0, r[0]))[1] == r[0]) for r in rows]
    got = listed(multi_index.near_duplicates(df, per_cell=8, block=10, recall=1.0), "vec_id", "n_links", "component_id", "kept")
    assert got == expect(want)
    assert multi_index.near_duplicates(df.where("false")).collect() == []


def test_multi_sequence_visits_in_order():
    rng = random.Random(1)
    a, b = sorted(rng.random() for _ in range(8)), sorted(rng.random() for _ in range(9))
    got = [a[i] + b[j] for i, j in multi_index.multi_sequence(a, b, 0.9)]
    assert got == sorted(x + y for x in a for y in b if x + y <= 0.9)


def test_grid_visits_are_the_multi_sequence():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    grid = multi_index.Grid(x, 9, 0.9, 0.99)
    a, b = grid.distances(x)
    a, b = a - a.min(1, keepdims=True), b - b.min(1, keepdims=True)
    got: dict = {}
    for r, c in zip(*(v.tolist() for v in grid.visits(x)), strict=True):
        got.setdefault(r, []).append(divmod(c, grid.size[1]))
    for r in range(400):
        oa, ob = a[r].argsort(), b[r].argsort()
        want = [(int(oa[i]), int(ob[j])) for i, j in multi_index.multi_sequence(a[r][oa].tolist(), b[r][ob].tolist(), grid.radius)]
        assert sorted(got[r]) == sorted(want)
        sums = [a[r, i] + b[r, j] for i, j in got[r]]
        assert sums == sorted(sums) and got[r][0] == divmod(int(grid.cells(x)[r]), grid.size[1])


def test_multi_index_recall_at_the_default(spark):
    """Links of 6000 vectors, a third of them around two points along two directions, at the default recall."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(800, 64))
    loose = np.repeat(base, 5, axis=0) + rng.normal(size=(4000, 64)) * 0.24
    plane = rng.normal(size=(2, 64))
    hot = np.repeat(rng.normal(size=(2, 64)), 1000, axis=0) + rng.normal(size=(2000, 2)) @ plane * 0.2
    x = np.concatenate([loose, hot]).astype(np.float32).astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in multi_index.near_duplicates(df, per_cell=20, block=300).collect()}
    links = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (links <= near.sum(1)).all()
    assert links.sum() >= 0.98 * near.sum() and links[:4000].sum() >= 0.98 * near[:4000].sum() > 2000 and links[4000:].sum() >= 0.98 * near[4000:].sum()


@pytest.mark.parametrize("limit", [4 << 20, 0])
def test_decontamination(spark, docs, limit):
    rows, df = docs
    long = [t for _, t, *_ in rows if t and len(t.split()) > 60]
    items = [(k, " ".join(t.split()[5 : 5 + n]).encode().upper().decode()) for k, (t, n) in enumerate(zip(long, (10, 25, 40, 3, 12, 60, 1, 9), strict=False))]
    items += [(50, ""), (51, None), (None, "the"), (52, "no such words here at all"), (53, items[0][1]), (53, items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = fold(t)
        if i is not None and w:
            for k in range(max(1, len(w) - 9)):
                windows[tuple(w[k : k + 10])].add(str(i))
    want = []
    for i, t, *_ in rows:
        w, hit, found = fold(t), set(), set()
        for k in range(len(w)):
            for n in range(1, 11):
                if k + n <= len(w) and (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert sum(r[5] for r in want) > 5
    got = listed(decontamination.contamination(df, bench, broadcast_bytes=limit), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == expect(want)
    assert not any(r["contaminated"] for r in decontamination.contamination(df, bench.where("false")).collect())
    assert decontamination.contamination(empty(docs), bench).collect() == []


def tokenizer(name):
    return pytest.importorskip("public_tokenizers").path(name)


def test_sentencepiece(docs):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    rows, df = docs
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = []
    for i, t, *_ in rows:
        ids = sp.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert listed(sentencepiece_rounds.encode_documents(df, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expect(want)
    rng = random.Random(5)
    coder = sentencepiece_rounds.MergeRounds(path, cache_words=500)
    odd = ["", " ", "   a  b", "日本語", "\U0001f600 x", " " * 200, "▁", "a" * 3000, "\x00", "<s> </s> <0x41>", "a\t\tb\r\n c  "]
    odd += ["".join(rng.choice("ab 01▁ \n.,é日\U0001f600-=xyzthe") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    for text in odd:
        ids = sp.encode(text)
        assert coder.encode(text) == ids
        assert coder.decode(ids) == sp.decode(ids)


def test_token_files(docs, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    rows, df = docs
    library = Tokenizer.from_file(path)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for i, t, *_ in ordered:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    token_files.write(df, str(tmp_path), path, 1, shard_bytes=5000)
    assert listed(token_files.read(df.sparkSession, str(tmp_path)), "doc_id", "start", "n_tokens", "ids_crc32") == expect(want)
    token_files.write(empty(docs), str(tmp_path / "none"), path, 1)
    assert token_files.read(df.sparkSession, str(tmp_path / "none")).collect() == []
    rng = random.Random(5)
    odd = ["İstanbul Straße ΣΑΣ. a.b,c foo., don't I'LL <|endoftext|> x<|startoftext|>y 12 a3,", "éa ́ x y z　w \x1c q"]
    odd += ["".join(rng.choice("abAB .,'É́İiσΣ日12<|>  \n") for _ in range(rng.randint(1, 60))) for _ in range(800)]
    coder = token_files.ChunkEncoder(path, np.dtype("<u2"))
    assert coder.encode([t.encode() for t in odd]) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in odd]


def test_language(spark):
    rng = random.Random(1)
    words = {lang: ["".join(rng.choice(a) for _ in range(rng.randint(2, 8))) for _ in range(40)] for lang, a in (("aa", "abcdee"), ("bb", "xyzabo"), ("cc", "éètuvn"))}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang, "s") for i in range(120) for lang in [rng.choice(list(words))]]
    rows += [(200, None, "aa", "s"), (201, "", "aa", "s"), (202, "12 .,!", "bb", "s"), (203, "abc", None, "s"), (None, rows[0][1], "aa", "s"), (0, rows[0][1], rows[0][2], "s"), (204, "日本", None, "s"), (205, "edbca " * 20000, "aa", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language.fit(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    got = {(r["doc_id"], r["lang_pred"]): r for r in language.identify(df, model).collect()}
    assert len(language.identify(df, model).collect()) == len(rows)
    right = [(i, lang) in got for i, t, lang, _ in rows[:120]]
    assert sum(right) >= 118
    assert {k for k in got if k[0] in (200, 201, 202)} == {(200, "und"), (201, "und"), (202, "und")}
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got.values())
    alone = model.predict([rows[3][1]])
    among = model.predict([r[1] or "" for r in rows])
    assert alone[0][0] == among[0][3] and abs(alone[1][0] - among[1][3]) < 1e-9  # neighbours do not matter
    text = rows[3][1]
    assert model.predict([text, text[::-1] + " zzqq" * 9], reject=0.2)[0][1] == "und" and model.predict([text], reject=1e-9)[0] == [rows[3][2]]
    held = [np.mean(c < lim) for c, lim in zip(model.calibration, model.limits(0.2), strict=True)]
    assert max(held) <= 0.2 + 1e-9
    none = language.fit(df, F.lit(False))
    assert {r["lang_pred"] for r in language.identify(df, none).collect()} == {"und"}
    assert language.identify(df.where("false"), model).collect() == []


def test_kneser_ney_sums_to_one():
    model = language.KneserNey(["abab cab", "bca abc"], order=3)
    letters = [ord(c) for c in " abc"]
    for context in ([32, 32], [32, ord("a")], [ord("a"), ord("b")], [ord("c"), ord("z")]):
        code = np.array([x for c in letters for x in (*context, c)], np.uint32)
        p = np.exp(model.places(code))[2::3]
        assert p.sum() < 1 + 1e-9 and p.sum() > 0.9  # the rest is the unknown character's


class PlainKneserNey:
    """Interpolated Kneser-Ney by dictionaries of character tuples, as a textbook states it."""

    def __init__(self, texts, order, discount=0.75):
        self.order, self.d = order, discount
        folded = [self.fold(t) for t in texts]
        self.letters = len({c for t in folded for c in " " + t})
        top = collections.Counter()
        for t in folded:
            padded = " " * 7 + t
            for i in range(7, len(padded)):
                top[padded[i - order + 1 : i + 1]] += 1
        self.counts = {order: top}
        for n in range(order - 1, 0, -1):  # continuation counts: how many characters stand before
            self.counts[n] = collections.Counter(g[1:] for g in self.counts[n + 1])

    @staticmethod
    def fold(text):
        return re.sub(r" +", " ", "".join(c if c.isalpha() else " " for c in text.lower())).lstrip(" ")

    def p(self, context, c, n):
        if n == 0:
            return 1 / (self.letters + 1)
        context = context[len(context) - n + 1 :]
        followers = {g[-1]: k for g, k in self.counts[n].items() if g[:-1] == context}
        below = self.p(context, c, n - 1)
        if not followers:
            return below
        total = sum(followers.values())
        return max(followers.get(c, 0) - self.d, 0) / total + self.d * len(followers) / total * below

    def mean(self, text):
        padded = " " * 7 + self.fold(text)
        logs = [math.log(self.p(padded[:i], padded[i], self.order)) for i in range(7, len(padded))]
        return sum(logs) / max(1, len(logs))


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_kneser_ney_against_dictionaries(order):
    rng = random.Random(order)
    samples = {lang: [" ".join("".join(rng.choice(a) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 12))) for _ in range(12)] for lang, a in (("aa", "abcé"), ("bb", "xyzab"))}
    models = [language.KneserNey(ts, order) for ts in samples.values()]
    plain = [PlainKneserNey(ts, order) for ts in samples.values()]
    texts = [*samples["aa"][:4], *samples["bb"][:4], "Abc, xyz!  q1w", "zz", "é-É"]
    got, _ = language.LanguageModel([*samples], models, 4.0).means(texts)
    want = [[m.mean(t) for m in plain] for t in texts]
    assert np.allclose(got, want, rtol=1e-9, atol=1e-12)
    langs, score = language.LanguageModel([*samples], models, 4.0).predict(texts)
    for lang, p, row in zip(langs, score, want, strict=True):
        e = [math.exp(4 * (x - max(row))) for x in row]
        assert lang == [*samples][row.index(max(row))] and p == pytest.approx(max(e) / sum(e))


def test_quality_gradients_and_scores():
    rng = np.random.default_rng(3)
    rows, out, bias = rng.normal(size=(7, 4)), rng.normal(size=(4, 2)), rng.normal(size=2)
    share = rng.random(7)
    share /= share.sum()
    loss = lambda *a: quality.gradients(*a, 1)[0]
    _, of_mean, of_out, of_bias = quality.gradients(rows, share, out, bias, 1)

    def slope(x, at, *args):
        up, down = x.copy(), x.copy()
        up[at] += 1e-6
        down[at] -= 1e-6
        return (loss(*[up if a is x else a for a in args]) - loss(*[down if a is x else a for a in args])) / 2e-6

    args = (rows, share, out, bias)
    for at in np.ndindex(rows.shape):
        assert slope(rows, at, *args) == pytest.approx(share[at[0]] * of_mean[at[1]], abs=1e-7)
    assert all(slope(out, at, *args) == pytest.approx(of_out[at], abs=1e-7) for at in np.ndindex(out.shape))
    assert all(slope(bias, (k,), *args) == pytest.approx(of_bias[k], abs=1e-7) for k in range(2))
    # Features and scores text by text: words, pairs, and runs of 3 and 4 characters, never across texts.
    texts = ["a bb  a", "", "é日本 x", "ab", "日本語日本", " \n ", ""]
    f = quality.Features.of([t.encode() for t in texts], 1 << 12)
    model = quality.QualityModel(rng.normal(size=1 << 12).astype(np.float32), 0.3)
    scores = model.scores([t.encode() for t in texts])
    for i, t in enumerate(texts):
        words = t.split()
        n = [len(words), max(0, len(words) - 1), max(0, len(t) - 2), max(0, len(t) - 3)]
        assert [len(b[first[i] : last[i]]) for b, first, last in f.kinds] == n
        alone = quality.Features.of([t.encode()], 1 << 12).one(0)
        assert f.one(i).tolist() == alone.tolist()
        mean = sum(float(model.weight[b]) for b in alone) / max(1, len(alone))
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-mean - 0.3)))
    same = quality.Features.of(["日本語日本語".encode()], 1 << 12).one(0)[1:5].tolist()  # behind the one word
    assert same[0] == same[3] and len(set(same[:3])) == 3


def test_quality(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["the", "of", "and", "stone", "river", "wall"]) for _ in range(40))
    rows = [(i, good().upper().replace(" ", "!! ") if i % 5 == 0 else good(), "en") for i in range(300)]
    rows += [(400, None, "en"), (401, "", "en"), (None, good(), "en"), (7, rows[7][1], "en"), (402, "x" * 200_000, "en")]
    labels = [(i, 0 if i % 5 == 0 else 1, 0) for i in range(300)] + [(400, 1, 0), (3, None, 0), (None, 1, 0), (3, 1, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(df, lab, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    got = quality.score(df, model).collect()
    assert len(got) == len(rows)
    right = [r["predicted"] == (0 if r["doc_id"] % 5 == 0 else 1) for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 300]
    assert len(right) > 50 and sum(right) >= len(right) - 1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert quality.score(df.where("false"), model).collect() == []
    assert {r["predicted"] for r in quality.score(df, quality.fit(df, lab.where("false"), F.lit(True))).collect()} == {1}


def test_multi_index_links_vectors_of_every_length(spark):
    rng = np.random.default_rng(9)
    rows = []
    for d, n in ((16, 20), (8, 6), (1, 3), (3, 1)):
        for _ in range(n):
            v = [float(x) for x in np.abs(rng.normal(size=d)) + (d == 1)]
            rows += [(len(rows) + k, w) for k, w in enumerate((v, v, [2 * x for x in v]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    near = lambda a, b: len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95
    label = brute_components(rows, near)
    want = [(i, sum(near(v, w) for j, w in rows if j != i), c, i == c) for (i, v), c in zip(rows, label, strict=True)]
    assert listed(multi_index.near_duplicates(df), "vec_id", "n_links", "component_id", "kept") == expect(want)


def test_language_learns_rare_and_long_ones(spark):
    rng = random.Random(2)
    tags = [f"l{k:03}" for k in range(205)]
    word = lambda k: "".join(chr(0x4E00 + 40 * k + rng.randrange(30)) for _ in range(5))
    rows = [(k * 2 + c, " ".join(word(k) for _ in range(8)), tag) for k, tag in enumerate(tags) for c in range(1 if k > 199 else 2)]
    rows.append((1000, "qwx zqk " * 8000, "long"))
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert set(model.langs) == {*tags, "long"}
    assert model.predict(["qwx zqk qwx"])[0] == ["long"] and model.predict([rows[-2][1]])[0] == [tags[-1]]


def test_simhash_links_through_rows_without_id(spark, monkeypatch):
    rows = [(7, 0), (None, 0b111), (4, 0b111111), (None, 0xFFFF << 40), (None, 0xFFFF << 40)]
    monkeypatch.setattr(simhash, "map_pieces", lambda slim, make, schema: spark.createDataFrame(rows, schema))
    got = simhash.simhash_components(spark.createDataFrame([(7, "")], "doc_id long, text string"))
    assert listed(got, "doc_id", "component_id") == expect([(7, 4), (None, 4), (4, 4), (None, None), (None, None)])
