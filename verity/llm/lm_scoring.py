"""Operator 1: language-model scoring with a weighted back-off automaton.

The model is an n-gram model over words (order 3 by default): counts of n-grams, each history smoothed towards the
next shorter one with a Dirichlet prior, down to the smoothed unigram of the base score.

    p(w | h) = (c(hw) + k p(w | h')) / (c(h) + k)        h': h without its first word; k: one number per order

As an automaton: the root, and a state for each history that occurs in training (one or more words, or the start of
a text and the words from there). A state's arcs are its seen followers, weighted with log10 p(w | h), and lead to
the state of the longest history that ends in w; its failure arc leads to the state of h' and carries
log10(k / (c(h) + k)); the root has an arc for every word and one for all unknown words. One left-to-right traversal
carries the state, takes failure arcs until the state has an arc for the word, and adds up weights. Probabilities of
a state sum to one over the vocabulary and the unknown word.

The strength k of an order is the one at which the model expects as many first followers as training shows by Good
and Turing's estimate: the sum of k / (c(h) + k) over its tokens is the number of n-grams of that order that occur
once. It comes from the counts of counts over the whole corpus.

Counts come from all documents. A block asks about its distinct n-grams of all orders by GramCounts (an exchange), gets each
one's count, and builds the part of the automaton that its texts can reach. N-grams are told apart by 61-bit hashes
and their order: of 10^12 distinct ones about 2 * 10^5 share a hash with another one.

Nulls: a null text is empty (only the end token); a row with a null id is scored, and counted as training, since
its remainder is not 0. Repeated rows count as often as they occur. An empty table gives no rows. Without any
training row all counts are 0 and every score is the base score.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verity.llm import exchange
from verity.llm.blocks import PARTITIONS, Block, deal, groups, unpack
from verity.llm.common import crc_mod_py, cut, table
from verity.llm.hashing import U, Words, mix, segment_sums

START, END = U(0x243F6A8885A308D3), U(0x13198A2E03707344)
#: Text of a block: its n-grams take about 60 times as much memory.
BLOCK_BYTES = 6 << 20
SPARE_BITS = 20
#: Bits of a key for the order less one, so the largest order is 8.
ORDER_BITS = 3
#: Counts up to here are told apart in the counts of counts; larger ones fall in 16 classes for each power of two.
EXACT = 256


def order_of(key: np.ndarray, bits: int) -> np.ndarray:
    """Order less one."""
    return (key >> U(64 - bits - ORDER_BITS)).astype(np.int64) & ((1 << ORDER_BITS) - 1)


@dataclasses.dataclass
class Grams:
    """Tokens of a block's texts, and the distinct n-grams that end at them."""

    block: Block
    held: np.ndarray  # of each text
    count: np.ndarray  # tokens of each text
    first: np.ndarray  # first token of each text
    key: np.ndarray  # of each distinct n-gram, ascending
    train: np.ndarray  # how often it occurs in training texts
    order: np.ndarray  # its order ...
    at: np.ndarray  # ... and the token at which it ends first
    gram: list[np.ndarray]  # of each order, which n-gram ends at each token; -1: that would begin before the text's start

    @classmethod
    def of(cls, t: pa.Table, order: int, modulus: int, held: int, bits: int = 48) -> Grams:
        """bits: of a hash. A key has those, then the order less one, then zeros."""
        block = unpack(t)
        held_out = np.array([crc_mod_py(None if x else i, modulus) == held for i, x in zip(block.ids.tolist(), block.null.tolist(), strict=True)], bool)
        tokens, counts = [], []
        for a, b in groups(block.raw, 1 << 20):
            w = Words(block.raw[a:b], fold=True)
            n = np.diff(w.first)
            x = np.full(len(w.hash) + b - a, END)
            x[np.arange(len(w.hash)) + np.repeat(np.arange(b - a), n)] = w.hash
            tokens.append(x)
            counts.append(n + 1)
        token, count = np.concatenate(tokens), np.concatenate(counts)
        first = np.cumsum(count) - count
        place = np.arange(len(token)) - np.repeat(first, count)
        keys, ends, hashed, low = [], [], token, 64 - bits - ORDER_BITS
        for k in range(order):
            if k:  # the n-gram of k words that ends a token earlier, and this token
                before = np.append(U(0), hashed[:-1])
                if k == 1:
                    before[first] = START
                hashed = mix(before * U(0x9E3779B97F4A7C15) ^ token)
            ok = np.flatnonzero(place >= k - 1)
            keys.append(mix(hashed[ok] + U(k)) >> U(64 - bits) << U(64 - bits) | U(k << low))
            ends.append(ok)
        sizes = [len(x) for x in keys]
        at = np.concatenate(ends)
        key, one, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        train = np.bincount(inverse, np.repeat(~held_out, count)[at], len(key)).astype(np.int64)
        gram = []
        for ok, inv in zip(ends, np.split(inverse, np.cumsum(sizes)[:-1]), strict=True):
            g = np.full(len(token), -1, np.int64)
            g[ok] = inv
            gram.append(g)
        return cls(block, held_out, count, first, key, train, order_of(key, bits) + 1, at[one], gram)


class Automaton:
    """The states and arcs that a block's texts can reach.

    State 0 is the root, state 1 the start of a text, state 2 + g the history of n-gram g. `fail` and `fail_weight`
    are by state; `weight` is by n-gram: the arc of its last word from the state of the words before it.
    """

    def __init__(self, grams: Grams, count: np.ndarray, train: int, types: int, ends: int, strength: list[float]):
        self.grams, self.count = grams, count
        n, top = len(grams.key), len(grams.gram)
        self.begins = np.zeros(len(grams.gram[0]), bool)
        self.begins[grams.first] = True
        self.fail = np.zeros(n + 2, np.int64)
        self.fail_weight = np.zeros(n + 2)
        p = np.zeros(n)
        for k in range(1, top + 1):
            g = np.flatnonzero(grams.order == k)
            at = grams.at[g]
            if k == 1:
                p[g] = (count[g] + 0.1) / (train + 0.1 * (types + 1))
                continue
            s = strength[k - 1]
            history = self.history(k - 1, at)
            c = np.where(history == 1, ends, count[np.maximum(history - 2, 0)])
            p[g] = (count[g] + s * p[grams.gram[k - 2][at]]) / (c + s)
            # This n-gram as a history: the next shorter one ends at the same word.
            self.fail[g + 2] = grams.gram[k - 2][at] + 2
        self.weight = np.log10(p)
        for k in range(1, top):  # states of k words: what passes on to the next shorter history
            g, s = np.flatnonzero(grams.order == k), strength[k]
            self.fail_weight[g + 2] = np.log10(s / (count[g] + s))
        self.fail_weight[1] = np.log10(strength[1] / (ends + strength[1])) if top > 1 else 0.0

    def history(self, words: int, at: np.ndarray) -> np.ndarray:
        """State of the `words` symbols before each token; -1 where a text has fewer."""
        before = np.where(self.begins[at], -1, self.grams.gram[words - 1][at - 1])
        state = np.where(before < 0, -1, before + 2)
        return np.where(self.begins[at] & (words == 1), 1, state)

    def traverse(self) -> np.ndarray:
        """Accumulated weight of each text.

        The state before a token is that of the longest history (its arcs lead there), so all texts are walked at
        once: every token stands at its state, and those without an arc from there fail together until none is left.
        """
        gram, tokens = self.grams.gram, np.arange(len(self.begins))
        total = np.zeros(len(tokens))
        state, words = np.full(len(tokens), -1), np.zeros(len(tokens), np.int64)
        for k in range(len(gram) - 1, 0, -1):
            open_ = np.flatnonzero(state < 0)
            state[open_] = found = self.history(k, open_)
            words[open_] = np.where(found >= 0, k, 0)
        state[state < 0] = 0
        while len(tokens):
            k = words[tokens]
            arc = np.stack([g[tokens] for g in gram])[k, np.arange(len(tokens))]
            has = (k == 0) | (self.count[arc] > 0)
            total[tokens[has]] += self.weight[arc[has]]
            tokens = tokens[~has]
            total[tokens] += self.fail_weight[state[tokens]]
            state[tokens], words[tokens] = self.fail[state[tokens]], words[tokens] - 1
        return segment_sums(total, self.grams.first, self.grams.first + self.grams.count)


def classes(total: np.ndarray) -> np.ndarray:
    """Class of each count for the counts of counts."""
    exp = np.frexp(np.maximum(total, 1).astype(np.float64))[1].astype(np.int64)
    return np.where(total < EXACT, total, EXACT + exp * 16 + (total >> np.maximum(exp - 5, 0)) % 16)


def counted(key: np.ndarray, total: np.ndarray, bits: int) -> bytes:
    """Of each order and class of counts: distinct n-grams and their occurrences, as rows of four numbers."""
    some = total > 0
    total, order = total[some], order_of(key[some], bits)
    both, place = np.unique(order << 32 | classes(total), return_inverse=True)
    return np.stack([both >> 32, both & 0xFFFFFFFF, np.bincount(place, minlength=len(both)), np.bincount(place, total, len(both)).astype(np.int64)], axis=1).astype("<i8").tobytes()


def _totals(answers: DataFrame) -> list[tuple[int, int, int, int]]:
    """Counts of counts of the corpus: (order - 1, class, n-grams, occurrences); some hundreds of rows for each order."""

    def unpack_rows(batches):
        for batch in batches:
            x = np.concatenate([np.zeros((0, 4), "<i8"), *(np.frombuffer(d, "<i8").reshape(-1, 4) for d in batch.column("data").to_pylist())])
            yield pa.RecordBatch.from_arrays([pa.array(x[:, k]) for k in range(4)], ["o", "c", "types", "tokens"])

    found = answers.where("node < 0").select("data").mapInArrow(unpack_rows, "o long, c long, types long, tokens long")
    return [tuple(r) for r in found.groupBy("o", "c").agg(F.sum("types"), F.sum("tokens")).collect()]


def strengths(totals: list[tuple[int, int, int, int]], order: int) -> list[float]:
    """k of each order (the first is not used)."""
    out = [1.0]
    for k in range(1, order):
        n = np.array([(tokens / types, tokens) for o, _, types, tokens in totals if o == k - 1], np.float64).reshape(-1, 2)
        once = sum(types for o, c, types, _ in totals if o == k and c == 1)
        low, high = 1e-3, 1e6
        for _ in range(80):  # the expected number of first followers grows with k
            mid = (low * high) ** 0.5
            low, high = (mid, high) if (n[:, 1] * mid / (n[:, 0] + mid)).sum() < once else (low, mid)
        out.append((low * high) ** 0.5)
    return out


class GramCounts(exchange.Counts):
    """Counts of n-grams in fewer bytes: a hash and its order are nearly random, so what can be saved is in how they
    are written. Hashes travel as differences, the low bytes of a difference as they are; what is above them (a byte,
    255: the 64-bit tail has the whole difference), and order and number (a byte, from 31 on the number is in the
    tail) are few different values, which an entropy coder takes to little more than they say."""

    def __init__(self, summary, bits: int):
        super().__init__(summary)
        self.low = 64 - bits - ORDER_BITS

    def pack(self, request) -> bytes:
        key, value = request
        order = (key >> U(self.low)) & U((1 << ORDER_BITS) - 1)
        gap = np.diff(key >> U(self.low + ORDER_BITS), prepend=U(0))
        # As many low bytes that what is above them is 64 on average at most.
        width = max(0, min(7, (max(1, int(gap[1:].mean()) if len(gap) > 1 else 1).bit_length() + 1) // 8))
        above = gap >> U(8 * width)
        far, many = above >= 255, value >= 31
        squeeze = zstandard.ZstdCompressor(level=1).compress
        streams = [squeeze(np.where(far, 255, above).astype(np.uint8).tobytes()), squeeze((np.where(many, 31, value).astype(np.uint8) << ORDER_BITS | order.astype(np.uint8)).tobytes())]
        head = np.array([len(key), width, far.sum(), *map(len, streams)], "<u4")
        low = np.ascontiguousarray(gap.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
        return b"".join([head.tobytes(), *streams, low.tobytes(), gap[far].astype("<u8").tobytes(), value[many].astype("<u8").tobytes()])

    def unpack(self, data: bytes):
        n, width, far, *lengths = np.frombuffer(data, "<u4", 5).tolist()
        at, streams, opener = 20, [], zstandard.ZstdDecompressor()
        for length in lengths:
            streams.append(np.frombuffer(opener.decompress(data[at : at + length]), np.uint8))
            at += length
        above, both = streams
        gap = np.zeros((n, 8), np.uint8)
        gap[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        gap = gap.view("<u8").ravel() | above.astype(U) << U(8 * width)
        at += n * width
        gap[above == 255] = np.frombuffer(data, "<u8", far, at)
        value = (both >> ORDER_BITS).astype(np.int64)
        value[value == 31] = np.frombuffer(data, "<u8", offset=at + 8 * far)
        order = (both & ((1 << ORDER_BITS) - 1)).astype(U)
        return (np.cumsum(gap, dtype=U) << U(ORDER_BITS) | order) << U(self.low), value


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 10, held: int = 0, order: int = 3, fan_bits: int = exchange.FAN_BITS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    dealt, n = deal(docs, id_col, text_col, BLOCK_BYTES)
    bits = min(64 - ORDER_BITS, SPARE_BITS + (order * n * BLOCK_BYTES // 6).bit_length())
    kind = GramCounts(lambda key, total: counted(key, total, bits), bits)

    def ask(t: pa.Table) -> pa.Table:
        g = Grams.of(t, order, modulus, held, bits)
        return exchange.messages(kind, (g.key, g.train), t.column("block")[0].as_py(), n, fan_bits)

    answers = cut(exchange.answers(dealt.groupBy("block").applyInArrow(ask, exchange.ROW), kind, n, fan_bits))
    totals = _totals(answers)
    train, types = (sum(r[k] for r in totals if r[0] == 0) for k in (3, 2))
    strength = strengths(totals, order)

    def finish(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_arrays([pa.array([], f.type) for f in OUT], schema=OUT)
        g = Grams.of(left, order, modulus, held, bits)
        count = exchange.joined(kind, right)
        last = g.gram[0][g.first + g.count - 1]  # the end token: once in every text
        model = Automaton(g, count, train, types, int(count[last[0]]), strength)
        base, known = (segment_sums(x[g.gram[0]], g.first, g.first + g.count) for x in (model.weight, count > 0))
        cols = [g.block.id_array(), pa.array(g.held), pa.array(g.count.astype(np.int64)), pa.array(known.round().astype(np.int64)), pa.array(np.full(len(g.held), train, np.int64)), pa.array(base), pa.array(model.traverse())]
        return pa.Table.from_arrays(cols, schema=OUT)

    replies = answers.where("node >= 0").select(F.col("node").alias("block"), "digit", "data").repartition(min(n, PARTITIONS), "block")
    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, SCHEMA)


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
