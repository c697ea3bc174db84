"""Blocks of documents.

Operators that look up something about every token or window of a corpus work in blocks: documents dealt by a hash
of their id and text so that a block holds about `block_bytes` of text (a longer text is a block's alone). A block
asks about each of its distinct keys once (see exchange). Blocks grow in number with the input and keep their size;
they lie in at most `partitions` partitions, whose tasks work one block at a time.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verity.llm.common import pieces, quoted, total_bytes

#: Stands for a null id in comparisons: none comes after it. Which ids are null is kept apart (Block.null).
LAST_ID = 2**63 - 1
BLOCK_BYTES = 8 << 20
#: Most partitions that blocks are dealt to.
PARTITIONS = 8192
#: Bytes of text that a task gathers before it packs what it has for each block.
PACK_BYTES = 16 << 20


def deal(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES, carry: bool = False) -> tuple[DataFrame, int]:
    """(block, data) dealt by block, and how many blocks; data packs some documents of the block (see unpack).

    Texts travel compressed, many at a time, which takes half the bytes of a shuffle of single rows. Null texts
    become empty. With carry, whole rows come along in a column `row`, without their texts.
    """
    slim = docs.select(
        quoted(docs, id_col).cast("long").alias("doc_id"), F.coalesce(quoted(docs, text_col).cast("string"), F.lit("")).alias("text"),
        *[F.struct(*(quoted(docs, c).alias(c) for c in docs.columns if c != text_col)).alias("row")] * carry,
    )
    _, size = total_bytes(slim, "text")
    n = max(1, -(-size // block_bytes))
    placed = slim.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))

    def pack(batches):
        packer, held, size = zstandard.ZstdCompressor(level=3), [], 0
        for batch in batches:
            for piece in pieces(batch, "text"):
                held.append(piece)
                size += piece.nbytes
                if size >= PACK_BYTES:
                    yield packed(held, packer)
                    held, size = [], 0
        if held:
            yield packed(held, packer)

    return placed.mapInArrow(pack, "block int, data binary").repartition(min(n, PARTITIONS), "block"), n


def packed(held: list[pa.RecordBatch], packer) -> pa.RecordBatch:
    t = pa.Table.from_batches(held).combine_chunks()
    block = t.column("block").to_numpy()
    t, order = t.drop_columns(["block"]), np.argsort(block, kind="stable")
    block = block[order]
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    data = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
        part = t.take(pa.array(order[a:b])).combine_chunks().to_batches()[0]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema) as out:
            out.write_batch(part)
        data.append(packer.compress(sink.getvalue()))
    return pa.RecordBatch.from_arrays([pa.array(block[starts], pa.int32()), pa.array(data, pa.binary())], ["block", "data"])


@dataclasses.dataclass
class Block:
    """Documents of a block in order of id and text (the order of a shuffle is not fixed); null ids come last."""

    ids: np.ndarray
    null: np.ndarray
    raw: list[bytes]
    rows: pa.Array | None  # carried ones

    def id_array(self) -> pa.Array:
        return pa.array(self.ids, mask=self.null)


def unpack(t: pa.Table) -> Block:
    opener = zstandard.ZstdDecompressor()
    parts = [pa.ipc.open_stream(opener.decompress(d)).read_all() for d in t.column("data").to_pylist()]
    if not parts:
        return Block(np.zeros(0, np.int64), np.zeros(0, bool), [], None)
    t = pa.concat_tables(parts)
    column = t.column("doc_id").combine_chunks()
    null, ids = column.is_null().to_numpy(zero_copy_only=False), column.fill_null(LAST_ID).to_numpy(zero_copy_only=False)
    raw = [x for c in t.column("text").chunks for x in c.cast(pa.binary()).to_pylist()]
    order = sorted(range(len(raw)), key=lambda i: (ids[i], null[i], raw[i]))
    rows = t.column("row").combine_chunks().take(pa.array(order, pa.int64())) if "row" in t.column_names else None
    return Block(ids[order], null[order], [raw[i] for i in order], rows)


def groups(raw: list[bytes], limit: int) -> list[tuple[int, int]]:
    """Ranges of consecutive texts of about `limit` bytes."""
    out, a, n = [], 0, 0
    for i, t in enumerate(raw):
        n += len(t)
        if n >= limit:
            out.append((a, i + 1))
            a, n = i + 1, 0
    if a < len(raw):
        out.append((a, len(raw)))
    return out


def pack_uints(x: np.ndarray) -> bytes:
    """Non-negative integers: one byte each up to 254; 255 says that the next of the 64-bit tail has the value."""
    big = x >= 255
    return np.where(big, 255, x).astype(np.uint8).tobytes() + x[big].astype("<u8").tobytes()


def unpack_uints(data: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(data, np.uint8, n).astype(np.int64)
    x[x == 255] = np.frombuffer(data, "<u8", offset=n).astype(np.int64)
    return x
