"""Operator 8: SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is escaped as the model's normaliser does (blank to U+2581, one put in front) and cut before each run of
U+2581: no piece of such a vocabulary holds that mark after another character, so no merge crosses a cut. All
words new to the task lie in flat numpy arrays of symbols. A round takes for each word the smallest pair rank,
merges the leftmost non-overlapping pairs of that rank in all words at once, and compacts, until no pair remains.

Merging all equal pairs of a word at once equals the one-at-a-time order as long as a merge opens no pair of the
same or a better rank. A word where one does (runs of blanks are such) is done again with one merge per round.

Nulls and empty texts have no ids. Rows are independent: repeated rows and clashing columns do not matter.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from verity.llm.common import map_pieces, quoted, table

MARK = "▁"
_WORD = re.compile(f"{MARK}+[^{MARK}]*")
_NONE = np.int32(2**31 - 1)


class MergeRounds:
    """An encoder and decoder for a SentencePiece BPE model with byte fallback and an identity normaliser."""

    def __init__(self, model_file: str, cache_words: int = 300_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("the model must be BPE with byte fallback, a dummy prefix and an identity normaliser")
        self.pieces = [p.piece for p in model.pieces]
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece holds the blank mark inside; texts cannot be cut at blanks")
        self.byte_id = [normal.get(f"<0x{b:02X}>", -1) for b in range(256)]
        self.byte_of: dict[int, int] = {}
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                b = int(p.piece[3:5], 16)
                self.byte_id[b], self.byte_of[i] = i, b
        self.size = len(model.pieces)
        #: Whether a symbol is a piece of text (the last entry is for characters outside the vocabulary).
        self.plain = np.array([*(p.type == 1 for p in model.pieces), False])
        self.text_of = [p.replace(MARK, " ") for p in self.pieces]
        self.number = [str(i) for i in range(self.size)]
        scores = np.array([p.score for p in model.pieces])
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        keys, merged = [], []
        for piece, i in normal.items():
            for k in range(1, len(piece)):
                a, b = normal.get(piece[:k]), normal.get(piece[k:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    merged.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.pair_key = np.array(keys, np.int64)[order]
        self.pair_piece = np.array(merged, np.int32)[order]
        self.pair_rank = rank[self.pair_piece]
        chars = sorted((ord(p), i) for p, i in normal.items() if len(p) == 1)
        self.char_code = np.array([c for c, _ in chars], np.uint32)
        self.char_piece = np.array([i for _, i in chars], np.int32)
        self.cache_words, self.ids, self.shown = cache_words, {}, {}

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of adjacent symbols; unknown characters are negative and pair with nothing."""
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.pair_key, key)
        at[at == len(self.pair_key)] = 0
        hit = self.pair_key[at] == key
        return np.where(hit, self.pair_rank[at], _NONE), np.where(hit, self.pair_piece[at], -1)

    def encode_words(self, words: list[str], strict: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words one after another, and how many each word has.

        A symbol is a piece id, or -1 - code point for a character outside the vocabulary.
        """
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.searchsorted(self.char_code, flat)
        at[at == len(self.char_code)] = 0
        sym = np.where(self.char_code[at] == flat, self.char_piece[at], -1 - flat.astype(np.int32)).astype(np.int32)
        seg = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        redo: list[np.ndarray] = []
        rank, piece = self._pairs(sym, seg)
        while len(sym):
            starts = np.flatnonzero(np.diff(seg, prepend=-1))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(sym)))
            live = best != _NONE
            if not live.all():  # words without a pair are done
                keep = np.repeat(live, sizes)
                done.append((seg[~keep], sym[~keep]))
                sym, seg, rank, piece = sym[keep], seg[keep], rank[keep], piece[keep]
                best, sizes = best[live], sizes[live]
                if not len(sym):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, sizes))
            if strict:
                hits = hits[np.flatnonzero(np.diff(seg[hits], prepend=-1))]
            else:  # in a run of overlapping pairs every second one, from the left
                first = np.flatnonzero(np.diff(hits, prepend=-2) != 1)
                within = np.arange(len(hits)) - np.repeat(first, np.diff(np.append(first, len(hits))))
                hits = hits[within % 2 == 0]
            old = rank[hits]
            sym[hits] = piece[hits]
            keep = np.ones(len(sym), bool)
            keep[hits + 1] = False
            new = hits - np.arange(len(hits))  # where they stand after compaction
            sym, seg, rank, piece = sym[keep], seg[keep], rank[keep], piece[keep]
            for left in (new - 1, new):  # the pairs that each merge has made
                inside = (left >= 0) & (seg[np.maximum(left, 0)] == seg[new])
                left, mine, were = left[inside], seg[new[inside]], old[inside]
                right = np.minimum(left + 1, len(sym) - 1)
                ok = (right > left) & (seg[right] == mine)
                r, p = np.full(len(left), _NONE, np.int32), np.full(len(left), -1, np.int32)
                r[ok], p[ok] = self._lookup(sym[left[ok]], sym[right[ok]])
                rank[left], piece[left] = r, p
                if not strict and (bad := r <= were).any():
                    redo.append(np.unique(mine[bad]))
                    gone = np.isin(seg, redo[-1])
                    rank[gone] = _NONE
        counts = np.zeros(len(words), np.int64)
        if done:
            seg, sym = (np.concatenate(x) for x in zip(*done, strict=True))
            if redo:
                again = np.unique(np.concatenate(redo))
                keep = ~np.isin(seg, again)
                more, lengths = self.encode_words([words[w] for w in again.tolist()], strict=True)
                seg, sym = np.append(seg[keep], np.repeat(again, lengths)), np.append(sym[keep], more)
            sym = sym[np.argsort(seg, kind="stable")]
            counts += np.bincount(seg, minlength=len(words))
        return sym, counts

    def _pairs(self, sym, seg):
        rank, piece = np.full(len(sym), _NONE, np.int32), np.full(len(sym), -1, np.int32)
        rank[:-1], piece[:-1] = self._lookup(sym[:-1], sym[1:])
        ends = np.flatnonzero(np.diff(seg)) if len(seg) else np.zeros(0, int)
        rank[ends], piece[ends] = _NONE, -1
        return rank, piece

    def expand(self, symbols: list[int]) -> list[int]:
        """Ids of symbols: characters outside the vocabulary become the pieces of their bytes."""
        ids: list[int] = []
        for s in symbols:
            ids += [s] if s >= 0 else [self.byte_id[b] for b in chr(-1 - s).encode("utf-8")]
        return ids

    def decode_ids(self, ids: list[int]) -> str:
        """Text of ids with blanks restored; the dummy prefix is still there."""
        parts, raw = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                raw.append(b)
                continue
            if raw:
                parts.append(_lenient(bytes(raw)))
                raw.clear()
            parts.append(self.pieces[i])
        if raw:
            parts.append(_lenient(bytes(raw)))
        return "".join(parts).replace(MARK, " ")

    def learn(self, words: set[str]) -> None:
        """Encode the words that the cache lacks; the cache is bounded and starts anew when full."""
        missing = [w for w in words if w not in self.ids]
        if len(self.ids) + len(missing) > self.cache_words:
            self.ids.clear()
            self.shown.clear()
            missing = list(words)
        number, text_of = self.number, self.text_of
        for a in range(0, len(missing), 30_000):
            part = missing[a : a + 30_000]
            symbols, counts = self.encode_words([MARK + w for w in part])
            plain = np.logical_and.reduceat(self.plain[np.maximum(symbols, -1)], np.cumsum(counts) - counts)
            symbols, at = symbols.tolist(), 0
            for w, n, simple in zip(part, counts.tolist(), plain.tolist(), strict=True):
                ids = symbols[at : at + n]
                at += n
                if not simple:
                    ids = self.expand(ids)
                self.ids[w] = ",".join([number[i] for i in ids])
                self.shown[w] = "".join([text_of[i] for i in ids]) if simple else self.decode_ids(ids)

    def words(self, text: str) -> list[str]:
        """The words of a text, each without the mark that it begins with."""
        if not text:
            return []
        if text[0] == " " or "  " in text or MARK in text:
            return [w[1:] for w in _WORD.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def encode(self, text: str) -> list[int]:
        words = self.words(text)
        self.learn(set(words))
        return [int(x) for w in words for x in self.ids[w].split(",")]

    def decode(self, ids: list[int]) -> str:
        return self.decode_ids(ids).removeprefix(" ")


def _lenient(raw: bytes) -> str:
    """Bytes of byte pieces; each byte that is no valid UTF-8 becomes U+FFFD, as the library does."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode("utf-8"))
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


@functools.cache
def _coder(model_file: str) -> MergeRounds:
    """One for each Python worker, so that its cache outlives a task."""
    return MergeRounds(model_file)


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per row of docs: id, n_tokens, ids_sha256, decoded_sha256, and the ids themselves if keep_ids.

    Map-only: no shuffle; a task holds one Arrow batch and a bounded cache of words.
    """
    slim = docs.select(quoted(docs, id_col).cast("long").alias("doc_id"), quoted(docs, text_col).cast("string").alias("text"))

    def make():
        coder = _coder(model_file)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            cut = [coder.words(t or "") for t in batch.column("text").to_pylist()]
            coder.learn(set().union(*cut))
            n, ids_sha, text_sha, kept = [], [], [], []
            for words in cut:
                ids = ",".join(map(coder.ids.__getitem__, words))
                n.append(ids.count(",") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256("".join(map(coder.shown.__getitem__, words)).removeprefix(" ").encode()).hexdigest())
                if keep_ids:
                    kept.append([int(x) for x in ids.split(",")] if ids else [])
            cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols, names = [*cols, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            return pa.RecordBatch.from_arrays(cols, names)

        return step

    return map_pieces(slim, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
