"""Repeated passages: which windows of a document also start in an earlier one, and where.

A window of `length` symbols has as its anchor the smallest hash of the `gram`-symbol runs in it. Equal windows have
equal anchors, wherever they stand, and neighbouring windows mostly share one. A block goes through three rounds:

1. It asks how often each of its anchors occurs (exchange.Counts). Windows whose anchor no second document has are done.
2. Some anchors occur very often (over HOT times: a line that many documents hold), mostly in windows that reach
   beyond the line and so differ. Of those anchors it asks about each window's own hash, and drops windows that no
   second document has: what is left of a line is what its holders have in common.
3. It cuts the stretches of its texts whose windows are left and asks about those (kind Stretches below): all
   occurrences of a window meet in the part of the key space of its anchor, where an operator's own `find` compares
   them by what they say. Equal stretches of a block or a team are one entry under the first document that has them.

HOT only says which windows are looked at twice; it does not change a result. An anchor that is hot in windows that do
repeat, each in a few documents (a line in many documents, each of which has a copy), is not divided further.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verity.llm import exchange
from verity.llm.blocks import LAST_ID, PARTITIONS, Block, deal
from verity.llm.exchange import Counts, ranges_of
from verity.llm.hashing import mix

NONE = LAST_ID
HOT = 2000
BLOCK_BYTES = 4 << 20


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each x[i:i + width]."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    size, m = 1, x
    while size * 2 <= width:
        m = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    if size < width:
        m = np.minimum(m[:n], m[width - size : width - size + n])
    return m


def flat(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... count[i] of them, for each i."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def runs_of(low: np.ndarray, begin: np.ndarray, size: np.ndarray, length: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor in texts that lie one after another: (text, first window, last window, anchor).

    low: anchor of the window at each place; begin, size: of each text, in symbols. A run has at most `most` windows,
    as many as can share one place of an anchor: a text that says the same over and over is cut in equal stretches.
    """
    new = np.ones(len(low), bool)
    new[1:] = low[1:] != low[:-1]
    new[begin[begin < len(low)]] = True
    behind = begin + np.maximum(size - length + 1, 0)  # no window starts from here to the next text
    new[behind[behind < len(low)]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(low))
    some = np.flatnonzero(size >= length)
    if not len(some) or not len(start):
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64))
    text = some[np.maximum(np.searchsorted(begin[some], start, side="right") - 1, 0)]
    ok = (start >= begin[text]) & (start < begin[text] + size[text] - length + 1)
    start, end, text = start[ok], end[ok], text[ok]
    pieces = -(-(end - start) // most)
    start = np.repeat(start, pieces) + most * flat(np.zeros(len(pieces), np.int64), pieces)
    end, text = np.minimum(start + most, np.repeat(end, pieces)), np.repeat(text, pieces)
    return text, start - begin[text], end - 1 - begin[text], mix(low[start])  # minima crowd at the low end


@dataclasses.dataclass
class Runs:
    """Runs of windows of a block's documents; cut(document, first window, last window) is a run's stretch."""

    block: Block
    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    cut: Callable[[int, int, int], bytes]

    @classmethod
    def join(cls, block: Block, parts: list[tuple], cut) -> Runs:
        kinds = (np.int64, np.int64, np.int64, np.uint64)
        return cls(block, *(np.concatenate([np.zeros(0, k), *(p[i] for p in parts)]) for i, k in enumerate(kinds)), cut)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors, how many runs each has (1 if all are of one id), and which of them each run has."""
        known, place = np.unique(self.anchor, return_inverse=True)
        low, high = np.full(len(known), LAST_ID, np.int64), np.full(len(known), -(2**63), np.int64)
        ids = self.block.ids[self.doc]
        np.minimum.at(low, place, ids)
        np.maximum.at(high, place, ids)
        return known, np.where(low != high, np.bincount(place, minlength=len(known)), 1), place

    def keep(self, flags: np.ndarray) -> Runs:
        return dataclasses.replace(self, doc=self.doc[flags], first=self.first[flags], last=self.last[flags], anchor=self.anchor[flags])

    def only(self, hot: np.ndarray, flags: np.ndarray) -> Runs:
        """Without those windows of hot runs (one after another) that are not flagged; runs stay in order."""
        some = self.keep(hot)
        windows = some.last - some.first + 1
        run, at = np.repeat(np.arange(len(some.doc)), windows)[flags], flat(some.first, windows)[flags]
        new = np.flatnonzero((np.diff(run, prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1))
        end = at[np.append(new[1:], len(at)) - 1] if len(new) else at[:0]
        cold = self.keep(~hot)
        doc, first, last, anchor = (np.append(x, y) for x, y in ((cold.doc, some.doc[run[new]]), (cold.first, at[new]), (cold.last, end), (cold.anchor, some.anchor[run[new]])))
        order = np.lexsort((first, doc))
        return dataclasses.replace(self, doc=doc[order], first=first[order], last=last[order], anchor=anchor[order])

    def stretches(self) -> Passages:
        parts = [self.cut(d, a, b) for d, a, b in zip(self.doc.tolist(), self.first.tolist(), self.last.tolist(), strict=True)]
        return Passages(self.anchor, parts, self.last - self.first + 1, self.block.ids[self.doc], self.first)


@dataclasses.dataclass
class Passages:
    """Stretches: anchor, bytes, how many windows start in it, and the id and place of where it stands first."""

    anchor: np.ndarray
    parts: list[bytes]
    windows: np.ndarray
    ids: np.ndarray
    at: np.ndarray

    def take(self, i: int, j: int) -> Passages:
        return Passages(self.anchor[i:j], self.parts[i:j], self.windows[i:j], self.ids[i:j], self.at[i:j])

    def edges(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.windows)]).astype(np.int64)


class Stretches:
    """A kind of exchange. The reply says of each window the id and place of an earlier document's, or NONE.

    find(passages) -> (ids, places): of each window of distinct stretches, from stretches of its anchor with a
    smaller id; only stretches of one anchor can have a window in common.
    """

    def __init__(self, find: Callable[[Passages], tuple[np.ndarray, np.ndarray]]):
        self.find = find

    @staticmethod
    def pack(p: Passages) -> bytes:
        lengths = np.array([len(x) for x in p.parts], np.int64)
        parts = [Counts.pack((p.anchor, p.windows)), lengths.astype("<u4").tobytes(), p.ids.astype("<i8").tobytes(), p.at.astype("<i8").tobytes()]
        head = np.array([len(lengths), len(parts[0])], "<u8").tobytes()
        return zstandard.ZstdCompressor(level=1).compress(b"".join([head, *parts, *p.parts]))

    @staticmethod
    def unpack(data: bytes) -> Passages:
        data = zstandard.ZstdDecompressor().decompress(data)
        n, size = (int(x) for x in np.frombuffer(data, "<u8", 2))
        at = 16 + size
        anchor, windows = Counts.unpack(data[16:at])
        lengths, ids, places = np.frombuffer(data, "<u4", n, at), np.frombuffer(data, "<i8", n, at + 4 * n), np.frombuffer(data, "<i8", n, at + 12 * n)
        ends = (at + 20 * n + np.cumsum(lengths, dtype=np.int64)).tolist()
        return Passages(anchor, [data[a:b] for a, b in zip([at + 20 * n, *ends[:-1]], ends, strict=True)], windows, ids, places)

    @staticmethod
    def split(p: Passages, bits: int, used: int):
        return [(d, p.take(i, j)) for d, i, j in ranges_of(p.anchor, bits, used)]

    @staticmethod
    def merge(requests: list[Passages]) -> tuple[Passages, list[np.ndarray]]:
        """Distinct stretches by anchor and bytes, and which of them each request's are."""
        known: dict[bytes, int] = {}
        place = np.array([known.setdefault(x, len(known)) for p in requests for x in p.parts], np.int64)
        anchor, windows, ids, at = (np.concatenate([getattr(p, k) for p in requests]) for k in ("anchor", "windows", "ids", "at"))
        order = np.lexsort((at, ids, place))
        first = order[np.flatnonzero(np.diff(place[order], prepend=-1))]  # of each distinct one, where it stands first
        parts = list(known)
        by = sorted(range(len(parts)), key=parts.__getitem__)
        by = np.array(by, np.int64)[np.argsort(anchor[first[by]], kind="stable")] if by else np.zeros(0, np.int64)
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        first = first[by]
        whole = Passages(anchor[first], [parts[i] for i in by.tolist()], windows[first], ids[first], at[first])
        return whole, np.split(rank[place], np.cumsum([len(p.parts) for p in requests])[:-1])

    def resolve(self, whole: Passages):
        """Stretches that are alone with their anchor have no earlier window: what is equal is one entry."""
        sid, sat = np.full(int(whole.windows.sum()), NONE, np.int64), np.zeros(int(whole.windows.sum()), np.int64)
        _, group, size = np.unique(whole.anchor, return_inverse=True, return_counts=True)
        crowd = np.flatnonzero(size[group] > 1)
        if len(crowd):
            some = Passages(whole.anchor[crowd], [whole.parts[i] for i in crowd.tolist()], whole.windows[crowd], whole.ids[crowd], whole.at[crowd])
            where = flat(whole.edges()[:-1][crowd], some.windows)
            sid[where], sat[where] = self.find(some)
        return sid, sat

    @staticmethod
    def back(whole: Passages, reply, request: Passages, place: np.ndarray):
        """What is told of a stretch's first copy; a stretch of a later document has that copy before it as well."""
        where = flat(whole.edges()[:-1][place], request.windows)
        sid, sat = reply[0][where], reply[1][where]
        copy = np.repeat(request.ids > whole.ids[place], request.windows) & (sid == NONE)
        offset = flat(np.zeros(len(place), np.int64), request.windows)
        sid[copy] = np.repeat(whole.ids[place], request.windows)[copy]
        sat[copy] = (np.repeat(whole.at[place], request.windows) + offset)[copy]
        return sid, sat

    @staticmethod
    def join(replies):
        return tuple(np.concatenate([np.zeros(0, np.int64), *(r[k] for r in replies)]) for k in (0, 1))

    @staticmethod
    def pack_reply(reply) -> bytes:
        sid, sat = reply
        where = np.flatnonzero(sid != NONE)
        start = where[chains(where, sid[where], sat[where])]
        count = np.diff(np.append(np.searchsorted(where, start), len(where)))
        data = np.concatenate([[len(sid), len(start)], start, count, sid[start], sat[start]]).astype("<i8").tobytes()
        return zstandard.ZstdCompressor(level=1).compress(data)

    @staticmethod
    def unpack_reply(data: bytes):
        x = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i8")
        start, count, ids, places = x[2:].reshape(4, int(x[1]))
        sid, sat = np.full(int(x[0]), NONE, np.int64), np.zeros(int(x[0]), np.int64)
        where = flat(start, count)
        sid[where], sat[where] = np.repeat(ids, count), flat(places, count)
        return sid, sat

    @staticmethod
    def summary(whole, reply):
        return None


def chains(where: np.ndarray, sid: np.ndarray, sat: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Whether each found window opens a chain: it isn't the next place of the same source as the one before."""
    new = np.ones(len(where), bool)
    new[1:] = (np.diff(where) != 1) | (sid[1:] != sid[:-1]) | (np.diff(sat) != 1)
    for x in more:
        new[1:] |= x[1:] != x[:-1]
    return new


def search(docs: DataFrame, id_col: str, text_col: str, runs: Callable[[pa.Table], Runs], hashes, find, finish, schema, carry: bool = False, fan_bits: int = exchange.FAN_BITS, hot: int = HOT, deal=deal) -> DataFrame:
    """finish(runs, ids, places) of each block -> table of `schema`: its runs that may repeat, and for each of their
    windows, one after another, an earlier document's id and place or NONE. hashes(passages) -> hash of each window."""
    dealt, n = deal(docs, id_col, text_col, BLOCK_BYTES, carry=carry)
    counts, stretches = Counts(), Stretches(find)
    none = exchange.rows([])

    def ask(request, kind, t: pa.Table) -> pa.Table:
        return exchange.messages(kind, request, t.column("block")[0].as_py(), n, fan_bits)

    def ask_anchors(t: pa.Table) -> pa.Table:
        known, value, _ = runs(t).anchors()
        return ask((known, value), counts, t) if len(known) else none

    def repeated(t: pa.Table, told: pa.Table) -> tuple[Runs, np.ndarray]:
        """Runs whose anchor a second document has, and which of them are hot."""
        r = runs(t)
        if not len(r.doc) or not told.num_rows:
            return r.keep(np.zeros(len(r.doc), bool)), np.zeros(0, bool)
        total = exchange.joined(counts, told)[r.anchors()[2]]
        return r.keep(total > 1), total[total > 1] > hot

    def windows(r: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes of the runs' windows, 1 or (if documents of different ids have it) 2 for each, and which of
        them each window has."""
        every = dataclasses.replace(r, doc=np.repeat(r.doc, r.last - r.first + 1), anchor=hashes(r.stretches()))
        known, value, place = every.anchors()
        return known, np.minimum(value, 2), place

    def ask_windows(key, left: pa.Table, right: pa.Table) -> pa.Table:
        r, many = repeated(left, right) if left.num_rows else (None, np.zeros(0, bool))
        if not many.any():
            return none
        known, value, _ = windows(r.keep(many))
        return ask((known, value), counts, left)

    def left_over(left: pa.Table, right: pa.Table) -> Runs:
        about = right.column("about").to_numpy()
        r, many = repeated(left, right.filter(pa.array(about == 0)))
        if many.any():
            flags = exchange.joined(counts, right.filter(pa.array(about == 1)))[windows(r.keep(many))[2]] > 1
            r = r.only(many, flags)
        return r

    def ask_stretches(key, left: pa.Table, right: pa.Table) -> pa.Table:
        own = left_over(left, right).stretches() if left.num_rows else None
        return ask(stretches.merge([own])[0], stretches, left) if own and own.parts else none

    def done(key, left: pa.Table, right: pa.Table) -> pa.Table:
        r = left_over(left, right)
        own = r.stretches()
        whole, places = stretches.merge([own])
        reply = exchange.joined(stretches, right.filter(pa.array(right.column("about").to_numpy() == 2)))
        return finish(r, *stretches.back(whole, reply, own, places[0]))

    parts = min(n, PARTITIONS)
    by_block = dealt.groupBy("block")

    def told(asked: DataFrame, kind, about: int) -> DataFrame:
        replies = exchange.answers(asked, kind, n, fan_bits).where("node >= 0")
        return replies.select(F.col("node").alias("block"), "digit", "data", F.lit(about).alias("about"))

    def beside(replies: DataFrame):
        return by_block.cogroup(replies.repartition(parts, "block").groupBy("block"))

    anchors = told(by_block.applyInArrow(ask_anchors, exchange.ROW), counts, 0)
    known = anchors.unionByName(told(beside(anchors).applyInArrow(ask_windows, exchange.ROW), counts, 1))
    known = known.unionByName(told(beside(known).applyInArrow(ask_stretches, exchange.ROW), stretches, 2))
    return beside(known).applyInArrow(done, schema)
