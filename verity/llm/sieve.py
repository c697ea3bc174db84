"""A bounded Bloom filter: it keeps rows out of a shuffled join that the join would not match.

The filter passes every row that has one of the keys, and few others, so that the join behind it stays exact. It has
16 bits a key up to MOST bits; with more keys than that it passes more rows, up to all, and never takes more room.
A key sets two bits of one segment, so that each task builds segments of its own and the driver holds the bits once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter at most (8 MB) and of a segment (as many as 16 bits number).
MOST, SEGMENT = 1 << 26, 1 << 16


def places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits in its segment of each key, a 64-bit hash."""
    return keys & 0xFFFF, keys >> 16 & 0xFFFF


def sieve(keys: DataFrame, columns: list[str], most: int = MOST) -> Column:
    """A condition on rows that have these columns: true for all rows with the columns' values in a row of keys."""
    key = F.xxhash64(*columns)
    n = keys.count()
    if not n:
        return F.lit(False)
    segments = max(1, min(most, 1 << (16 * n - 1).bit_length()) // SEGMENT)

    def build(batches):
        held = {}
        for b in batches:
            hashes, own = b.column("key").to_numpy(), b.column("segment").to_numpy()
            for s in np.unique(own).tolist():
                bits = held.setdefault(s, np.zeros(SEGMENT, bool))
                for at in places(hashes[own == s]):
                    bits[at] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], ["segment", "bits"])

    dealt = keys.select(key.alias("key")).withColumn("segment", F.shiftrightunsigned("key", 48).bitwiseAND(F.lit(segments - 1)))
    whole = np.zeros((segments, SEGMENT // 8), np.uint8)
    for r in dealt.repartition(min(segments, 64), "segment").mapInArrow(build, "segment long, bits binary").collect():
        whole[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    sent = keys.sparkSession.sparkContext.broadcast(whole)

    @F.arrow_udf("boolean")
    def passes(hashes: pa.Array) -> pa.Array:
        bits, h = sent.value, hashes.to_numpy(zero_copy_only=False)
        own, ok = h.view(np.uint64) >> np.uint64(48) & np.uint64(segments - 1), np.ones(len(h), bool)
        for at in places(h):
            ok &= bits[own.astype(np.int64), at >> 3] >> (7 - (at & 7)) & 1 == 1
        return pa.array(ok)

    return passes(key)
