"""Operator 2: substring dedup by relative Lempel-Ziv parsing.

The reference is all documents: the phrases (strings of `length` consecutive words) of each are indexed in blocks of
the key space under the smallest doc_id in which they stand, with a place there. A document is factored greedily
from left to right against every reference block that can hold one of its phrases. Where the phrase at hand stands
in a smaller doc_id, a factor begins there, and it grows by a word as long as the phrase that ends with that word
stands next in the same reference document; it is copied from (source, place), and at least `length` words long.
Else the word is a literal. At a factor's boundary the phrases that straddle its end are looked up like all others,
so a match that begins inside one factor and ends behind it is a factor of its own, which overlaps the one before.
The words of factors are duplicate spans.

Reference blocks hold the words themselves (passages.Stretches): hashes choose what to compare, each chain of
phrases is compared with its source word for word, and if one differs the block is indexed by its words instead.

Nulls: a null text has no words; a row with a null id comes after all others and removes nothing from them. Rows
with equal ids do not remove each other's words. Texts shorter than a phrase stay whole. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from verity.llm import exchange
from verity.llm.blocks import deal, groups, unpack
from verity.llm.common import table
from verity.llm.hashing import Words, prefix, ranges
from verity.llm.passages import HOT, NONE, Passages, Runs, chains, flat, runs_of, search, sliding_minimum

GRAM = 8


def phrase_runs(t: pa.Table, length: int) -> Runs:
    """Runs of phrases of a block's documents; a stretch is its words joined by one blank."""
    block, parts, gram = unpack(t), [], min(GRAM, length)
    for a, b in groups(block.raw, 1 << 20):
        w = Words(block.raw[a:b])
        at = np.arange(max(0, len(w.hash) - gram + 1))
        low = sliding_minimum(ranges(prefix(w.hash), at, at + gram), length - gram + 1)
        doc, first, last, anchor = runs_of(low, w.first[:-1], np.diff(w.first), length, length - gram + 1)
        parts.append((doc + a, first, last, anchor))
    held: dict[int, list[bytes]] = {}  # the words of the document at hand

    def cut(doc: int, first: int, last: int) -> bytes:
        if doc not in held:
            held.clear()
            held[doc] = block.raw[doc].split()
        return b" ".join(held[doc][first : last + length])

    return Runs.join(block, parts, cut)


def phrase_hashes(p: Passages, length: int, w: Words | None = None) -> np.ndarray:
    w = w or Words(p.parts)
    start = flat(w.first[:-1], p.windows)  # word at which each phrase begins
    return ranges(prefix(w.hash), start, start + length)


def first_places(p: Passages, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each phrase of the stretches, where it stands first if that is a smaller doc_id."""
    w = Words(p.parts)
    start, hashes = flat(w.first[:-1], p.windows), phrase_hashes(p, length, w)
    ids, at = np.repeat(p.ids, p.windows), flat(p.at, p.windows)
    order = np.lexsort((at, ids, hashes))
    new = np.diff(hashes[order], prepend=hashes[order[0]] ^ hashes.dtype.type(1)) != 0
    owner = np.empty(len(order), np.int64)
    owner[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    found = np.flatnonzero(ids[owner] < ids)
    # Whole chains are compared at once: consecutive phrases whose first places are consecutive in one stretch.
    stretch = np.repeat(np.arange(len(p.parts)), p.windows)
    edge = np.flatnonzero(chains(found, stretch[owner[found]], owner[found], stretch[found]))
    a, b = found[edge], found[np.append(edge[1:], len(found)) - 1] if len(edge) else found
    begin, end = w.start, w.end
    for x, y, u, v in zip(begin[start[a]].tolist(), end[start[b] + length - 1].tolist(), begin[start[owner[a]]].tolist(), end[start[owner[b]] + length - 1].tolist(), strict=True):
        if w.raw[x:y] != w.raw[u:v]:
            return first_places_by_words(p, length)
    sid, sat = np.full(len(ids), NONE, np.int64), np.zeros(len(ids), np.int64)
    sid[found], sat[found] = ids[owner[found]], at[owner[found]]
    return sid, sat


def first_places_by_words(p: Passages, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the words themselves as keys: for a block in which two phrases share a hash."""
    words = [x.split(b" ") for x in p.parts]
    each = [(tuple(w[k : k + length]), i, a + k) for w, n, i, a in zip(words, p.windows.tolist(), p.ids.tolist(), p.at.tolist(), strict=True) for k in range(n)]
    first: dict[tuple, tuple[int, int]] = {}
    for phrase, i, a in each:
        first[phrase] = min(first.get(phrase, (i, a)), (i, a))
    told = [first[phrase] if first[phrase][0] < i else (NONE, 0) for phrase, i, _ in each]
    return np.array([i for i, _ in told], np.int64), np.array([a for _, a in told], np.int64)


def factors(doc: np.ndarray, at: np.ndarray, sid: np.ndarray, sat: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Greedy parse, from the found phrases in order of document and place: (document, first word, words, source,
    first word there) of each factor."""
    edge = np.flatnonzero(chains(at, sid, sat, doc))
    count = np.diff(np.append(edge, len(at)))
    return doc[edge], at[edge], count + length - 1, sid[edge], sat[edge]


FACTORS = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("source", pa.int64()), ("source_start", pa.int64())]))


def parse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, keep_text: bool = False, fan_bits: int = exchange.FAN_BITS, hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, and with keep_text the kept words as text
    (`kept`) and the document's `factors` in order (start, words, source, source_start)."""

    def finish(runs: Runs, sid: np.ndarray, sat: np.ndarray) -> pa.Table:
        block, found = runs.block, np.flatnonzero(sid != NONE)
        windows = runs.last - runs.first + 1
        spans = factors(np.repeat(runs.doc, windows)[found], flat(runs.first, windows)[found], sid[found], sat[found], length)
        edge = np.searchsorted(spans[0], np.arange(len(block.raw) + 1))
        n, removed, digests, kept, shown = [], [], [], [], []
        for i, t in enumerate(block.raw):
            words, mine = t.split(), list(zip(*(x[edge[i] : edge[i + 1]].tolist() for x in spans[1:]), strict=True))
            n.append(len(words))
            left, last = [], 0
            for start, size, *_ in mine:
                left += words[last:start]
                last = max(last, start + size)
            left += words[last:]
            text = b" ".join(left)
            removed.append(len(words) - len(left))
            digests.append(hashlib.sha256(text).hexdigest())
            if keep_text:
                kept.append(text.decode())
                shown.append([dict(zip(("start", "words", "source", "source_start"), f, strict=True)) for f in mine])
        cols = [block.id_array(), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if keep_text:
            cols, names = [*cols, pa.array(kept, pa.string()), pa.array(shown, FACTORS)], [*names, "kept", "factors"]
        return pa.Table.from_arrays(cols, names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string, factors array<struct<start: long, words: long, source: long, source_start: long>>" * keep_text
    return search(docs, id_col, text_col, lambda t: phrase_runs(t, length), lambda p: phrase_hashes(p, length), lambda p: first_places(p, length), finish, schema, fan_bits=fan_bits, hot=hot, deal=deal)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
win AS (SELECT doc_id, s, sha256(array_to_string(w[s:s + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d)),
hit AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY h) AS least FROM win) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 50)) AS p FROM hit)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = word.doc_id AND gone.p = word.p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
