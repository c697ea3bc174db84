"""Questions of blocks about keys that lie anywhere in the corpus, answered over a tree of merges.

A block asks once about each of its distinct keys. Keys are spread by a 64-bit hash, so that every part of the key
space holds equally many. With n blocks and a fan of f:

* n <= f: the key space is cut in n parts (a power of two), and each part gets a message from each block: n * n
  messages, at most n * f.
* n > f: the key space is cut in f parts, and the messages of a team of f blocks about one part meet in one task,
  which merges equal keys and asks on for the whole team. There are n / f teams and f parts, each a problem of its
  own with n / f askers. The answers come back the same way.

So there are at most n * f messages at each of log_f(n) levels, and a key that every block has is f entries in a
task of any level, however many blocks there are. What a task holds is at most what f blocks have to say about a
1/f of the key space: as much as one block has. Tasks are dealt over at most `partitions` partitions, which work
them off one after the other; all steps are shuffles of plain rows.

A kind says what a request is: Counts here (sums of numbers by key), Passages in passages.py.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verity.llm.blocks import pack_uints, unpack_uints
from verity.llm.hashing import U

FAN_BITS = 8
PARTITIONS = 8192
ROW = "scope long, node int, digit int, data binary"
_SCHEMA = pa.schema([("scope", pa.int64()), ("node", pa.int32()), ("digit", pa.int32()), ("data", pa.binary())])


def bits_for(nodes: int, fan_bits: int) -> int:
    return min(fan_bits, max(0, nodes - 1).bit_length())


def ranges_of(key: np.ndarray, bits: int, used: int) -> list[tuple[int, int, int]]:
    """(digit, first, last) of sorted 64-bit keys by their `bits` bits behind the `used` first ones."""
    if not len(key):
        return []
    if not bits:
        return [(0, 0, len(key))]
    digit = ((key << U(used)) >> U(64 - bits)).astype(np.int64)
    start = np.flatnonzero(np.diff(digit, prepend=-1))
    return list(zip(digit[start].tolist(), start.tolist(), [*start[1:].tolist(), len(key)], strict=True))


def rows(found: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in found], f.type) for k, f in enumerate(_SCHEMA)], schema=_SCHEMA)


def messages(kind, request, node: int, nodes: int, fan_bits: int = FAN_BITS, scope: int = 0, used: int = 0) -> pa.Table:
    """What an asker sends: rows of ROW."""
    return rows([(scope, node, d, kind.pack(part)) for d, part in kind.split(request, bits_for(nodes, fan_bits), used)])


def answers(asked: DataFrame, kind, nodes: int, fan_bits: int = FAN_BITS, partitions: int = PARTITIONS, used: int = 0) -> DataFrame:
    """Rows (scope, node, digit, data) with a reply for each row of asked, and rows with node -1 for the kind's summary."""
    bits = bits_for(nodes, fan_bits)

    def merged(t: pa.Table):
        order = np.argsort(t.column("node").to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        requests = [kind.unpack(d) for d in t.column("data").to_pylist()]
        whole, places = kind.merge(requests)
        return t, requests, whole, places

    def back(t, requests, whole, places, reply):
        scope, digit = t.column("scope")[0].as_py(), t.column("digit")[0].as_py()
        return [(scope, node, digit, kind.pack_reply(kind.back(whole, reply, r, p))) for node, r, p in zip(t.column("node").to_pylist(), requests, places, strict=True)]

    if nodes <= 1 << fan_bits:

        def answer(t: pa.Table) -> pa.Table:
            t, requests, whole, places = merged(t)
            reply = kind.resolve(whole)
            out = back(t, requests, whole, places, reply)
            summary = kind.summary(whole, reply)
            return rows(out + [(t.column("scope")[0].as_py(), -1, t.column("digit")[0].as_py(), summary)] * (summary is not None))

        tasks = min(partitions, 1 << min(30, used + bits))
        return asked.repartition(tasks, "scope", "digit").groupBy("scope", "digit").applyInArrow(answer, ROW)

    teams = -(-nodes // (1 << fan_bits))
    next_bits, mask = bits_for(teams, fan_bits), (1 << bits) - 1
    tasks = min(partitions, teams << min(30, used + bits))
    keyed = asked.withColumn("team", F.shiftright("node", fan_bits)).repartition(tasks, "scope", "digit", "team")

    def up(t: pa.Table) -> pa.Table:
        scope = t.column("scope")[0].as_py() << bits | t.column("digit")[0].as_py()
        _, _, whole, _ = merged(t)
        return rows([(scope, t.column("team")[0].as_py(), d, kind.pack(part)) for d, part in kind.split(whole, next_bits, used + bits)])

    upper = answers(keyed.groupBy("scope", "digit", "team").applyInArrow(up, ROW), kind, teams, fan_bits, partitions, used + bits)
    told = upper.where("node >= 0").select(
        F.shiftright("scope", bits).alias("scope"), F.col("scope").bitwiseAND(F.lit(mask)).cast("int").alias("digit"), F.col("node").alias("team"), F.col("digit").alias("part"), "data"
    )

    def down(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return rows([])
        t, requests, whole, places = merged(left)
        return rows(back(t, requests, whole, places, joined(kind, right, "part")))

    lower = keyed.groupBy("scope", "digit", "team").cogroup(told.repartition(tasks, "scope", "digit", "team").groupBy("scope", "digit", "team")).applyInArrow(down, ROW)
    return lower.unionByName(upper.where("node < 0"))


def joined(kind, t: pa.Table, part: str = "digit"):
    """One reply from the replies about the parts of a request."""
    order = np.argsort(t.column(part).to_numpy(), kind="stable")
    return kind.join([kind.unpack_reply(d) for d in t.column("data").take(pa.array(order)).to_pylist()])


class Counts:
    """A request: sorted distinct 64-bit keys and a number for each; the reply: each key's sum over all requests.

    Keys travel as differences, without the zero bits that all of them end with, in as many bytes each as makes
    them smallest; a difference that does not fit is all ones there and follows in eight bytes.
    """

    def __init__(self, summary=None):
        self._summary = summary

    @staticmethod
    def pack(request) -> bytes:
        key, value = request
        every = int(np.bitwise_or.reduce(key))
        zeros = (every & -every).bit_length() - 1 if every else 0
        gap = np.diff(key >> U(zeros), prepend=U(0))
        tops = [U((1 << 8 * w) - 1) for w in range(1, 9)]
        width = min(range(1, 9), key=lambda w: w * len(gap) + 8 * int((gap >= tops[w - 1]).sum()))
        far = gap >= tops[width - 1]
        near = np.where(far, tops[width - 1], gap).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        head = np.array([len(key), width, zeros, int(far.sum())], "<u8")
        return b"".join([head.tobytes(), near.tobytes(), gap[far].astype("<u8").tobytes(), pack_uints(value)])

    @staticmethod
    def unpack(data: bytes):
        n, width, zeros, far = (int(x) for x in np.frombuffer(data, "<u8", 4))
        gap = np.zeros((n, 8), np.uint8)
        gap[:, :width] = np.frombuffer(data, np.uint8, n * width, 32).reshape(-1, width)
        gap = gap.view("<u8").ravel()
        at = 32 + n * width
        gap[gap == U((1 << 8 * width) - 1)] = np.frombuffer(data, "<u8", far, at)
        return np.cumsum(gap, dtype=U) << U(zeros), unpack_uints(data[at + 8 * far :], n)

    @staticmethod
    def split(request, bits: int, used: int):
        key, value = request
        return [(d, (key[i:j], value[i:j])) for d, i, j in ranges_of(key, bits, used)]

    @staticmethod
    def merge(requests):
        key, place = np.unique(np.concatenate([k for k, _ in requests]), return_inverse=True)
        total = np.bincount(place, np.concatenate([v for _, v in requests]), len(key)).astype(np.int64)
        return (key, total), np.split(place, np.cumsum([len(k) for k, _ in requests])[:-1])

    @staticmethod
    def resolve(whole):
        return whole[1]

    @staticmethod
    def back(whole, reply, request, place):
        return reply[place]

    @staticmethod
    def join(replies):
        return np.concatenate(replies) if replies else np.zeros(0, np.int64)

    @staticmethod
    def pack_reply(reply) -> bytes:
        return np.array([len(reply)], "<u8").tobytes() + zstandard.ZstdCompressor(level=1).compress(pack_uints(reply))

    @staticmethod
    def unpack_reply(data: bytes):
        n = int(np.frombuffer(data, "<u8", 1)[0])
        return unpack_uints(zstandard.ZstdDecompressor().decompress(data[8:]), n)

    def summary(self, whole, reply) -> bytes | None:
        return self._summary(*whole) if self._summary else None
