"""Operator 6: suffix-array dedup with longest-previous-factor arrays.

Strings of `length` bytes that occur in an earlier document are removed, the first copy stays. A block cuts the
stretches of its texts whose windows share an anchor that a second document has (see passages); equal stretches are
one entry under the smallest doc_id. All occurrences of a string meet in the part of the key space of its anchor.
There the suffixes that begin a window are sorted (the suffix array, compared as far as a window reaches),
neighbours get their common prefix, and the longest previous factor of each suffix is found over the previous and the
next smaller document in suffix order. A factor of a whole window means that the string starts in an earlier document.

A passage that a third of all documents hold is one stretch for each block. Texts are compared by their bytes;
hashes only choose where to compare.

Nulls: a null text is empty; a row with a null id comes after all others and removes nothing from them. Rows with
equal ids do not remove each other's bytes. Texts shorter than a window stay whole. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verity.llm import exchange
from verity.llm.blocks import deal, groups, unpack
from verity.llm.common import table
from verity.llm.hashing import BYTE, U, prefix, ranges
from verity.llm.passages import HOT, NONE, Passages, Runs, flat, runs_of, search, sliding_minimum

GRAM = 24
PIECE = 256 << 10


def window_runs(t: pa.Table, length: int) -> Runs:
    """Runs of windows of a block's texts; a stretch is its bytes."""
    block, parts, gram = unpack(t), [], min(GRAM, length)
    for a, b in groups(block.raw, PIECE):
        joined = np.frombuffer(b"".join(block.raw[a:b]), np.uint8)
        if len(joined) < length:
            continue
        size = np.array([len(x) for x in block.raw[a:b]], np.int64)
        at = np.arange(len(joined) - gram + 1)
        low = sliding_minimum(ranges(prefix(BYTE[joined]), at, at + gram), length - gram + 1)
        doc, first, last, anchor = runs_of(low, np.cumsum(size) - size, size, length, length - gram + 1)
        parts.append((doc + a, first, last, anchor))
    return Runs.join(block, parts, lambda doc, first, last: block.raw[doc][first : last + length])


def suffix_order(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places `at` in the order of the `length` bytes from each, and the common prefix of each with the one before."""
    words = -(-length // 8)
    padded = np.concatenate([data, np.zeros(8 * words + 8, np.uint8)])
    whole = len(padded) // 8 * 8 - 8
    eight = np.empty(whole, U)  # the eight bytes from each place as a big-endian number
    for r in range(8):
        eight[r::8] = padded[r : r + whole].view(">u8")
    keys = [eight[at + 8 * k] for k in range(words)]
    if tail := length % 8:
        keys[-1] &= U((1 << 64) - (1 << (64 - 8 * tail)))
    order = np.lexsort(keys[::-1])
    common = np.zeros(len(at), np.int64)
    same = np.ones(max(0, len(at) - 1), bool)
    for key in keys:
        key = key[order]
        differ = key[1:] ^ key[:-1]
        bits = np.zeros(len(differ), np.int64)  # equal leading bytes of the first word that differs
        for j in range(1, 8):
            bits += (differ >> U(64 - 8 * j)) == 0
        common[1:] += np.where(same, np.where(differ == 0, 8, bits), 0)
        same &= differ == 0
    return order, np.minimum(common, length)


def previous_factors(docs: np.ndarray, common: np.ndarray, length: int) -> np.ndarray:
    """Longest previous factor of each suffix, as far as `length`: its common prefix with the nearer of the previous
    and the next suffix of a smaller document. docs and common stand in suffix order.

    The smaller one on either side is found by jumping in all places at once over pointers that skip only documents
    that are not smaller, with the minimum of common prefixes on the way; below `length` a jump can stop.
    """
    best = np.zeros(len(docs), np.int64)
    for back in (True, False):
        d = docs if back else docs[::-1]
        low = np.append(0, common[1:]) if back else np.append(0, common[1:][::-1])
        low = low.copy()
        to = np.arange(-1, len(d) - 1)
        while True:
            go = np.flatnonzero((low >= length) & (d[to] >= d))
            if not len(go):
                break
            via = to[go]
            low[go], to[go] = np.minimum(low[go], low[via]), to[via]
        found = np.where(low >= length, low, 0)
        best = np.maximum(best, found if back else found[::-1])
    return best


def window_hashes(p: Passages, length: int) -> np.ndarray:
    lengths = p.windows + length - 1
    start = flat(np.cumsum(lengths) - lengths, p.windows)
    return ranges(prefix(BYTE[np.frombuffer(b"".join(p.parts), np.uint8)]), start, start + length)


def earlier_windows(p: Passages, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of the stretches whether an earlier document has it: any id but NONE (places are not told)."""
    data = np.frombuffer(b"".join(p.parts), np.uint8)
    lengths = p.windows + length - 1
    order, common = suffix_order(data, flat(np.cumsum(lengths) - lengths, p.windows), length)
    found = np.zeros(len(order), bool)
    found[order] = previous_factors(np.repeat(p.ids, p.windows)[order], common, length) >= length
    return np.where(found, 0, NONE), flat(np.zeros(len(p.parts), np.int64), p.windows)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, keep_text: bool = False, fan_bits: int = exchange.FAN_BITS, hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with keep_text also `kept` (what
    remains as text; bytes of a character cut in two are dropped) and `row` (the other columns as they came)."""

    def finish(runs: Runs, sid: np.ndarray, sat: np.ndarray) -> pa.Table:
        block = runs.block
        size = np.array([len(x) for x in block.raw], np.int64)
        base = np.cumsum(size) - size
        windows = runs.last - runs.first + 1
        hit = (np.repeat(base[runs.doc], windows) + flat(runs.first, windows))[sid != NONE]
        mark = np.zeros(int(size.sum()) + 1, np.int32)
        np.add.at(mark, hit, 1)
        np.add.at(mark, hit + length, -1)
        cover = np.cumsum(mark[:-1], dtype=np.int32) > 0
        touched = np.bincount(runs.doc, minlength=len(block.raw))
        gone, spans, digests, kept = [], [], [], []
        for i, text in enumerate(block.raw):
            n_gone = n_spans = 0
            if touched[i]:
                mine = cover[base[i] : base[i] + size[i]]
                n_gone = int(mine.sum())
                if n_gone:
                    n_spans = int(mine[0]) + int((mine[1:] & ~mine[:-1]).sum())
                    text = np.frombuffer(text, np.uint8)[~mine].tobytes()
            gone.append(n_gone)
            spans.append(n_spans)
            digests.append(hashlib.sha256(text).hexdigest())
            if keep_text:
                kept.append(text.decode(errors="ignore"))
        cols = [block.id_array(), pa.array(size), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if keep_text:
            cols, names = [*cols, pa.array(kept, pa.string()), block.rows], [*names, "kept", "row"]
        return pa.Table.from_arrays(cols, names)

    schema = T.StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    if keep_text:
        schema = schema.add("kept", "string").add("row", T.StructType([docs.schema[c] for c in docs.columns if c != text_col]))
    return search(docs, id_col, text_col, lambda t: window_runs(t, length), lambda p: window_hashes(p, length), lambda p: earlier_windows(p, length), finish, schema, keep_text, fan_bits, hot, deal)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", length: int = 50) -> DataFrame:
    """The rows of docs with what remains of their texts (a null text becomes empty), and its characters counted."""
    left = remove_repeats(docs, id_col, text_col, length, keep_text=True)
    new = {text_col: F.col("kept")} | ({length_col: F.char_length("kept").cast(docs.schema[length_col].dataType)} if length_col in docs.columns else {})
    return left.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT doc_id, x, CAST(length(x) // 2 AS BIGINT) AS n FROM d),
win AS (SELECT doc_id, s, substr(x, 2 * s + 1, 100) AS w FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS s FROM n)),
hit AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY w) AS least FROM win) WHERE least < doc_id),
span AS (SELECT doc_id, s, coalesce(s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) > 50, true) AS opens FROM hit),
numbered AS (SELECT doc_id, s, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM span),
gone AS (SELECT doc_id, k, min(s) AS a, max(s) + 50 AS b FROM numbered GROUP BY doc_id, k),
cut AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before, k FROM gone),
pieces AS (SELECT n.doc_id, string_agg(substr(n.x, 2 * cut.before + 1, 2 * (cut.a - cut.before)), '' ORDER BY cut.a) AS head, max(cut.b) AS tail, sum(cut.b - cut.a) AS gone, count(*) AS spans
           FROM n JOIN cut ON cut.doc_id = n.doc_id GROUP BY n.doc_id)
SELECT n.doc_id, n.n AS n_bytes, CAST(coalesce(p.gone, 0) AS BIGINT) AS n_removed, coalesce(p.spans, 0) AS n_spans,
       sha256(unhex(coalesce(p.head || substr(n.x, 2 * p.tail + 1), n.x))) AS kept_sha256
FROM n LEFT JOIN pieces p ON p.doc_id = n.doc_id
"""
