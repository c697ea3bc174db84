"""Operator 9: token ids in flat unsigned files.

Format, a folder of shards in ascending order of doc_id:
  ids-NNNNNN.bin   token ids of the shard's documents one after another, little-endian unsigned (16 bits when the
                   vocabulary fits, else 32)
  idx-NNNNNN.bin   little-endian 64-bit: n + 1 offsets into the ids, then the n doc_ids (0 for the null ones, which
                   come first)
  manifest.json    dtype, and for each shard its documents, how many of them have a null doc_id, tokens and base
                   (tokens of all shards before it)

Documents are dealt by ranges of doc_id and sorted inside a range, so bases are prefix sums over one number per
shard. A task writes under a name of its own attempt and renames, so a repeated task leaves one whole shard.
Folders are opened through pyarrow's filesystems, so any shared store serves; local files are memory-mapped.

Null texts count as empty (the end id only); null doc_ids come first; rows with equal doc_ids all stay, ordered
by text; an empty table gives no shard with documents.
"""

from __future__ import annotations

import contextlib
import functools
import gc
import json
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verity.llm.common import pieces, quoted, shared_dir, table, texts, total_bytes
from verity.llm.hashing import Words
from verity.llm.passages import flat

#: ASCII punctuation without the apostrophe, which the tokenizer joins with letters.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

class ChunkEncoder:
    """Encodes with the tokenizers library, one white-space chunk at a time, through a bounded cache.

    It fits tokenizers of words with word ends that drop white space and tell letters from the rest (checked against
    whole texts in the tests): no token and no normalisation of theirs reaches across white space.
    """

    def __init__(self, tokenizer_file: str, dtype: np.dtype, cache_chunks: int = 600_000, cache_stems: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.limit = Tokenizer.from_file(tokenizer_file), dtype, cache_chunks
        self.stem_limit, self.stems = cache_stems, {}
        self.cache: dict[bytes, bytes] = {}
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.word_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.word_end[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.tails: dict[str, bytes] = {"": b""}

    def encode(self, batch: list[bytes]) -> list[bytes]:
        """Ids of each text as bytes of the file format.

        Chunks of all texts are hashed at once, distinct ones looked up or learnt, and their ids gathered in place.
        Two chunks of a batch with one 64-bit hash would be taken for one: for the chunks of 100 TB in batches of 1 MB
        that happens once with a probability under one in a hundred. Cached chunks are compared by their bytes.
        """
        w = Words(batch)
        key, first, place = np.unique(w.hash, return_index=True, return_inverse=True)
        chunks = [w.raw[i:j] for i, j in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)]
        found = list(map(self.cache.get, chunks))
        missing = [c for c, f in zip(chunks, found, strict=True) if f is None]
        if missing:
            if len(self.cache) + len(missing) > self.limit:
                self.cache.clear()
            learnt: dict[bytes, bytes] = {}
            for a in range(0, len(missing), 20_000):
                self._learn(missing[a : a + 20_000], learnt)
            self.cache.update(learnt)
            found = [learnt[c] if f is None else f for c, f in zip(chunks, found, strict=True)]
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        data, at = np.frombuffer(b"".join(found), self.dtype), np.cumsum(size) - size
        count = size[place]
        cuts = np.concatenate([[0], np.cumsum(count)])[w.first]
        raw = data[flat(at[place], count)].tobytes()
        cuts = (cuts * self.dtype.itemsize).tolist()
        return [raw[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def _learn(self, chunks: list[bytes], learnt: dict[bytes, bytes]) -> None:
        """Letters with punctuation behind them: stem and punctuation each have their own ids, and stems stay in a
        cache of their own. New stems are encoded together in one text and told apart by word ends."""
        split, rest, known = [], [], self.stems
        for chunk, c in zip(chunks, b" ".join(chunks).decode().split(" "), strict=True):
            stem = c.rstrip(PUNCTUATION)
            if stem.isalpha():
                split.append((chunk, stem.lower() if stem.isascii() else stem, c[len(stem) :]))
            else:
                rest.append((chunk, c))
        stems = {folded for _, folded, _ in split}
        if len(known) + len(stems) > self.stem_limit:
            known.clear()
        new = list(stems.difference(known))
        ids = np.array(self.batch([" ".join(new)], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.word_end[ids]) + 1 if len(ids) else ids
        if len(ends) == len(new):
            raw, cuts = ids.astype(self.dtype).tobytes(), (ends * self.dtype.itemsize).tolist()
            known.update(zip(new, [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)], strict=True))
        else:  # a letter that the tokenizer takes apart
            odd = set(new)
            rest += [(chunk, chunk.decode()) for chunk, folded, _ in split if folded in odd]
            split = [x for x in split if x[1] not in odd]
        for tail in {t for _, _, t in split}.difference(self.tails):
            if len(self.tails) > 10_000:
                self.tails = {"": b""}
            self.tails[tail] = self._ids(tail)
        tails = self.tails
        if any(t not in tails for _, _, t in split):  # more kinds of punctuation than are kept
            tails = {t: self._ids(t) for t in {t for _, _, t in split}}
        learnt.update([(chunk, known[folded] + tails[tail]) for chunk, folded, tail in split])
        for (chunk, _), e in zip(rest, self.batch([c for _, c in rest], add_special_tokens=False), strict=True):
            learnt[chunk] = np.array(e.ids, self.dtype).tobytes()

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()


@contextlib.contextmanager
def acyclic():
    """No search for cycles meanwhile: it would walk through the caches again and again, and nothing here makes any."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


@functools.cache
def _encoder(tokenizer_file: str, dtype: str) -> ChunkEncoder:
    """One for each Python worker, so that its cache outlives a task."""
    return ChunkEncoder(tokenizer_file, np.dtype(dtype))


def write(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 24 << 20) -> dict:
    """Encode docs into folder (a URI or path); returns the manifest, which holds a few numbers per shard."""
    from tokenizers import Tokenizer

    vocabulary = max(end_id, *Tokenizer.from_file(tokenizer_file).get_vocab().values()) + 1
    slim = docs.select(quoted(docs, id_col).cast("long").alias("doc_id"), quoted(docs, text_col).cast("string").alias("text"))
    _, size = total_bytes(slim, "text")
    dtype = np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")
    shards = max(1, -(-size // shard_bytes))
    dealt = slim.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        from pyspark import TaskContext

        store, root = _store(folder)
        shard, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        coder, end = _encoder(tokenizer_file, dtype.str), np.array([end_id], dtype).tobytes()
        name, lengths, ids, nulls = f"{root}/ids-{shard:06d}.bin", [np.zeros(1, "<i8")], [], 0
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{name}.{attempt}") as out:
            for batch in batches:
                for piece in pieces(batch, "text"):
                    with acyclic():
                        coded = [c + end for c in coder.encode(texts(piece))]
                    out.write(b"".join(coded))
                    lengths.append(np.array([len(c) for c in coded], "<i8") // dtype.itemsize)
                    nulls += piece.column("doc_id").null_count
                    ids.append(pc.fill_null(piece.column("doc_id"), 0).to_numpy(zero_copy_only=False).astype("<i8"))
        offsets = np.cumsum(np.concatenate(lengths), dtype="<i8")
        index = f"{root}/idx-{shard:06d}.bin"
        with store.open_output_stream(f"{index}.{attempt}") as out:
            out.write(offsets.tobytes())
            for part in ids:
                out.write(part.tobytes())
        store.move(f"{name}.{attempt}", name)
        store.move(f"{index}.{attempt}", index)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(offsets) - 1], pa.int64()), pa.array([int(offsets[-1])], pa.int64()), pa.array([nulls], pa.int64())], ["shard", "documents", "tokens", "nulls"])

    done = sorted(dealt.mapInArrow(run, "shard int, documents long, tokens long, nulls long").collect())
    bases = np.cumsum([0, *(r["tokens"] for r in done)]).tolist()
    manifest = {"dtype": dtype.str, "end_id": end_id, "tokens": bases[-1], "shards": [{"shard": r["shard"], "documents": r["documents"], "tokens": r["tokens"], "nulls": r["nulls"], "base": b} for r, b in zip(done, bases, strict=False)]}
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32; the files are mapped, not loaded."""
    store, root = _store(folder)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    dtype = np.dtype(manifest["dtype"])
    rows = [(s["shard"], s["base"], s["documents"], s["nulls"]) for s in manifest["shards"] if s["documents"]]
    shards = spark.createDataFrame(rows, "shard int, base long, documents long, nulls long").repartition(max(1, len(rows)), "shard")

    def run(batches):
        store, root = _store(folder)
        for batch in batches:
            for shard, base, n, nulls in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = np.frombuffer(_mapped(store, f"{root}/idx-{shard:06d}.bin"), "<i8")
                ids = np.frombuffer(_mapped(store, f"{root}/ids-{shard:06d}.bin"), dtype)
                offsets, doc_ids = raw[: n + 1], raw[n + 1 :]
                for a in range(0, n, 20_000):
                    b = min(n, a + 20_000)
                    cuts = offsets[a : b + 1].tolist()
                    crcs = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                    docs = pa.array(doc_ids[a:b], mask=np.arange(a, b) < nulls)
                    yield pa.RecordBatch.from_arrays([docs, pa.array(offsets[a:b] + base), pa.array(np.diff(offsets[a : b + 1])), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def _mapped(store: fs.FileSystem, path: str):
    if isinstance(store, fs.LocalFileSystem):
        if not os.path.getsize(path):
            return b""
        return pa.memory_map(path).read_buffer()
    with store.open_input_file(path) as f:
        return f.read_buffer()


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_dir(spark)
    write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read(spark, folder)
