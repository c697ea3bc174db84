"""Operator 5: SimHash near-dedup with a self-join of a binary trie.

Fingerprints of distinct value are what is joined; rows of a fingerprint follow it, so a group of copies of any
size is one entry. Two fingerprints within `bits` differ nowhere in at least one of bits + 1 equal parts: each
distinct fingerprint goes once for each part to the shuffle partition of (part, its value). A partition holds one
sorted array, which is a forest of binary tries with a root per (part, value), and joins it with itself: pairs of
nodes go down together one bit at a time, differing bits add up, and a pair over the error budget is dropped. What
a partition returns is a spanning forest of the links that it found, never the pairs of a group; links of all
partitions meet in distributed connected components.

Nulls: a null text has no words, hence fingerprint zero, linked like any other; a null doc_id has a fingerprint
and a component but never represents a component that holds an id. Repeated rows each have their row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verity.llm.common import cut, map_pieces, quoted, table, texts
from verity.llm.components import Forest, components


def shingle_hashes(raw: list[bytes], shingle: int, seed: int = 42) -> tuple[list[int], np.ndarray]:
    """Hashes of the word shingles of all texts (A-Z lower-cased, words between white space), and how many each has."""
    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    for t in raw:
        words = t.lower().split()
        n = max(1, len(words) - shingle + 1) if words else 0
        counts.append(n)
        if not n:
            continue
        text = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = (ends - [len(w) + 1 for w in words])[:n].tolist()
        ends = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
        hashes += [digest(text[a:b], seed) for a, b in zip(starts, ends, strict=True)]
    return hashes, np.array(counts, np.int64)


def fingerprints_of(raw: list[bytes], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """SimHash of each text over its hashed word shingles."""
    hashes, counts = shingle_hashes(raw, shingle, seed)
    out = np.zeros(len(raw), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    first = (np.cumsum(counts) - counts)[some]
    data = np.array(hashes, np.uint64)
    votes = np.zeros((len(some), 64), np.int64)
    for a in range(0, len(some), 256):  # bits of a bounded number of texts at a time
        lo, hi = first[a], first[a + 256] if a + 256 < len(some) else len(data)
        bits = np.unpackbits(data[lo:hi].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes[a : a + 256] = np.add.reduceat(bits, first[a : a + 256] - lo, axis=0, dtype=np.int32)
    out[some] = np.packbits(votes * 2 > counts[some, None], axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def trie_join(root: np.ndarray, values: np.ndarray, bits: int, frontier: int = 1 << 20, neighbours: int = 0) -> Forest:
    """Forest over the entries (sorted by root, then value): links of values of one root within `bits`. A value is a
    64-bit word, or a row of them, the first words being the upper bits.

    Nodes are ranges of the sorted array. A pair of nodes is (lo, hi, lo, hi, differing bits, depth); pairs are
    taken off a stack in blocks of at most `frontier`, so memory stays bounded. With `neighbours`, entries are linked
    with as many that follow them first, and pairs of nodes that this has made one component do not go down: a large
    group of close values then costs its runs in the array and not its pairs.
    """
    forest = Forest(len(values))
    if len(values) < 2:
        return forest
    words = [np.ascontiguousarray(w) for w in values.reshape(len(values), -1).T]
    length = 64 * len(words)
    differ = lambda a, b: sum(np.bitwise_count(w[a] ^ w[b]).astype(np.int64) for w in words)
    for k in range(1, min(neighbours, len(values) - 1) + 1):
        a = np.flatnonzero(root[k:] == root[:-k])
        a = a[differ(a, a + k) <= bits]
        forest.union(a, a + k)
    known = forest.roots()
    run = np.cumsum(np.diff(known, prepend=known[:1]) != 0)
    edge = np.flatnonzero(np.diff(root)) + 1
    lo, hi = np.concatenate([[0], edge]), np.concatenate([edge, [len(values)]])
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    zero = np.zeros(len(lo), np.int64)
    stack = [(0, lo, hi, lo, hi, zero)]
    while stack:
        depth, alo, ahi, blo, bhi, diff = stack.pop()
        if len(alo) > frontier:
            half = len(alo) // 2
            stack.append((depth, alo[half:], ahi[half:], blo[half:], bhi[half:], diff[half:]))
            alo, ahi, blo, bhi, diff = alo[:half], ahi[:half], blo[:half], bhi[:half], diff[:half]
            stack.append((depth, alo, ahi, blo, bhi, diff))
            continue
        if neighbours:
            open_ = (run[ahi - 1] != run[alo]) | (run[bhi - 1] != run[blo]) | (known[alo] != known[blo])
            alo, ahi, blo, bhi, diff = (x[open_] for x in (alo, ahi, blo, bhi, diff))
        leaf = (ahi - alo == 1) & (bhi - blo == 1)
        if leaf.any():  # single values: the remaining bits at once
            a, b = alo[leaf], blo[leaf]
            near = differ(a, b) <= bits
            forest.union(a[near], b[near])
            alo, ahi, blo, bhi, diff = (x[~leaf] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo):
            continue
        # A node none of whose members can differ in more than the budget is linked as a whole.
        whole = (length - depth) + diff <= bits
        if whole.any():
            for x, y, z, w in zip(alo[whole], ahi[whole], blo[whole], bhi[whole], strict=True):
                m = np.concatenate([np.arange(x, y), np.arange(z, w)])
                forest.union(m[1:], np.full(len(m) - 1, m[0]))
            alo, ahi, blo, bhi, diff = (x[~whole] for x in (alo, ahi, blo, bhi, diff))
            if not len(alo):
                continue
        am, bm = (_split(words[depth // 64], x, y, depth % 64) for x, y in ((alo, ahi), (blo, bhi)))
        own = alo == blo
        kids = [
            (alo, am, blo, bm, diff, np.ones(len(alo), bool)),
            (am, ahi, bm, bhi, diff, np.ones(len(alo), bool)),
            (alo, am, bm, bhi, diff + 1, np.ones(len(alo), bool)),
            (am, ahi, blo, bm, diff + 1, ~own),
        ]
        parts = []
        for x, y, z, w, d, ok in kids:
            ok = ok & (y > x) & (w > z) & (d <= bits) & ~((x == z) & (y - x == 1))
            parts.append([k[ok] for k in (x, y, z, w, d)])
        stack.append((depth + 1, *(np.concatenate(k) for k in zip(*parts, strict=True))))
    return forest


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """First entry of each range whose bit at `depth` (from the top) is set: a binary search in all ranges at once."""
    shift = np.uint64(63 - depth)
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        one = (values[np.minimum(mid, len(values) - 1)] >> shift) & np.uint64(1) == 1
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def near(distinct: DataFrame, bits: int, partitions: int) -> DataFrame:
    """Links (u, v) of a table of distinct fingerprints (fp long, rep long): a spanning forest for each partition."""
    width = 64 // (bits + 1)
    parts = F.explode(F.array(*(F.struct(F.lit(j).alias("part"), F.shiftrightunsigned(F.shiftleft("fp", j * width), 64 - width if j < bits else j * width).alias("value")) for j in range(bits + 1))))
    keyed = distinct.select("fp", "rep", parts.alias("p")).select("fp", "rep", (F.col("p.part") * F.lit(1 << 40) + F.col("p.value")).alias("root"))

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        fp, rep, root = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in got]) for k in ("fp", "rep", "root"))
        del got
        fp = fp.view(np.uint64)
        order = np.lexsort((fp, root))
        fp, rep, root = fp[order], rep[order], root[order]
        up = trie_join(root, fp, bits).roots()
        linked = np.flatnonzero(up != np.arange(len(up)))
        yield pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(rep[up[linked]])], ["u", "v"])

    return keyed.repartition(partitions, "root").mapInArrow(run, "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3, rows_per_partition: int = 60_000) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id."""
    slim = docs.select(quoted(docs, id_col).cast("long").alias("doc_id"), quoted(docs, text_col).cast("string").alias("text"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints_of(texts(batch), shingle).view(np.int64))], ["doc_id", "fp"])

        return step

    prints = cut(map_pieces(slim, make, "doc_id long, fp long"))  # 16 bytes a document, made once
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    partitions = max(4, -(-distinct.count() * (bits + 1) // rows_per_partition))
    # Fingerprints are linked by value, so that one whose rows have no id links others; ids come afterwards.
    whole = components(near(distinct.select("fp", F.col("fp").alias("rep")), bits, partitions))
    named = cut(distinct.join(whole, distinct["fp"] == whole["id"], "left").select("fp", "low", F.coalesce("component", "fp").alias("c")))
    lows = named.groupBy("c").agg(F.min("low").alias("component_id"))
    named = named.select(F.col("fp").alias("f"), "c").join(lows, "c").select("f", "component_id")
    return prints.join(named, prints["fp"] == named["f"], "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
