"""Operator 10: quality classifier with learned hashed subword vectors.

A document is the mean of the vectors of its features: words, pairs of words, and runs of 3 and 4 characters, each
hashed into a table. A softmax over two classes reads that mean. The table and the output weights are trained by
stochastic gradient descent in numpy, on the driver, on a bounded sample: at most `max_docs` labelled rows, lowest
hash of the id first, none above `max_bytes` (both are parameters of fit). Scoring is map-only: the output is linear
in the mean, so each feature's vector shrinks to one number and a table of `buckets` numbers goes to the tasks
whatever the size of the corpus.

Nulls: a null text is scored like an empty one; null labels and ids are not learnt from (a null id is not held
out); an id with both labels counts as 1, its texts each with that label. Every row is scored by its text alone.
With no labelled row, or none of one class, the score is a constant (the smoothed share of class 1, 0.5 without labels).
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verity.llm.common import crc_mod, crc_mod_py, map_pieces, quoted, table, texts
from verity.llm.hashing import U, Words, mix, segment_sums


def characters(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts and where each text's begin and end; bytes where the texts are no UTF-8."""
    try:
        code = np.frombuffer(w.raw.decode().encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        return w.buf.astype(np.uint32), w.text_start, w.text_end
    before = np.concatenate([[0], np.cumsum((w.buf & 0xC0) != 0x80)])
    return code, before[w.text_start], before[w.text_end]


@dataclasses.dataclass
class Features:
    """Buckets of all features of some texts, kind by kind: (bucket of each feature, first and last of each text)."""

    kinds: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, raw: list[bytes], buckets: int) -> Features:
        w = Words(raw)
        part = buckets // 4
        kinds = [((w.hash % U(part)).astype(np.int64), w.first[:-1], w.first[1:])]
        pair = mix(w.hash[1:] ^ (w.hash[:-1] << U(1)))
        kinds.append(((pair % U(part)).astype(np.int64) + part, w.first[:-1], np.maximum(w.first[1:] - 1, w.first[:-1])))
        code, begin, end = characters(w)
        for k, n in ((2, 3), (3, 4)):
            gram = code[: len(code) - n + 1].copy()
            for j in range(1, n):
                gram = gram * np.uint32(0x01000193) + code[j : len(code) - n + 1 + j]
            gram = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            kinds.append(((gram >> np.uint32(8)).astype(np.int64) % part + k * part, begin, np.maximum(end - n + 1, begin)))
        return cls(kinds)

    def one(self, i: int) -> np.ndarray:
        return np.concatenate([b[f[i] : l[i]] for b, f, l in self.kinds])


def gradients(rows: np.ndarray, share: np.ndarray, out: np.ndarray, bias: np.ndarray, label: int):
    """Loss of one document (vectors of its features, each one's share of them) and its gradients in the document's
    mean vector, in the output weights and in the bias; a feature's gradient is its share of the first."""
    mean = share @ rows
    z = mean @ out + bias
    p = np.exp(z - z.max())
    p /= p.sum()
    loss = -np.log(p[label])
    p[label] -= 1
    return loss, out @ p, np.outer(mean, p), p


class QualityModel:
    """weight[b]: what a feature of bucket b adds to the mean log-odds of class 1."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias

    @classmethod
    def fit(cls, raw: list[bytes], labels: list[int], buckets: int = 1 << 18, dim: int = 12, steps: int = 24_000, rate: float = 0.6, seed: int = 7) -> QualityModel:
        n1, n = sum(labels), len(labels)
        if not 0 < n1 < n:
            return cls(np.zeros(buckets, np.float32), float(np.log((n1 + 1) / (n - n1 + 1))))
        rng = np.random.default_rng(seed)
        table = (rng.random((buckets, dim), np.float32) - 0.5) / dim
        out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
        docs = []
        for a in range(0, n, 200):
            f = Features.of(raw[a : a + 200], buckets)
            for i in range(len(raw[a : a + 200])):
                u, c = np.unique(f.one(i), return_counts=True)
                docs.append((u.astype(np.int32), (c / max(1, c.sum())).astype(np.float32)))
        epochs = max(1, min(100, -(-steps // n)))
        step, steps = 0, epochs * n
        for _ in range(epochs):
            for i in rng.permutation(n).tolist():
                u, share = docs[i]
                lr = np.float32(rate * (1 - step / steps))
                step += 1
                rows = table[u]
                _, of_mean, of_out, of_bias = gradients(rows, share, out, bias, labels[i])
                out -= lr * of_out
                bias -= lr * np.float32(0.1) * of_bias
                # a feature's step is longer by the root of their number, since each has so small a share
                table[u] = rows - (lr * share * np.float32(len(u)) ** np.float32(0.5))[:, None] * of_mean
        return cls(table @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))

    def scores(self, raw: list[bytes]) -> np.ndarray:
        total, count = np.zeros(len(raw)), np.zeros(len(raw))
        for buckets, first, last in Features.of(raw, len(self.weight)).kinds:
            total += segment_sums(self.weight[buckets], first, last)
            count += last - first
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -50, 50)))


def fit(docs: DataFrame, labels: DataFrame, where, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = 4000, max_bytes: int = 100_000) -> QualityModel:
    """Train on at most max_docs of the labelled rows that `where` (a condition on column doc_id) admits."""
    ids = (
        labels.select(quoted(labels, id_col).cast("long").alias("doc_id"), quoted(labels, label_col).cast("int").alias("label"))
        .where(where & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    )
    slim = docs.select(quoted(docs, id_col).cast("long").alias("doc_id"), quoted(docs, text_col).cast("string").alias("text")).where(F.octet_length("text") <= max_bytes)
    picked = ids.collect()  # at most max_docs pairs of numbers
    chosen = docs.sparkSession.createDataFrame(picked, "doc_id long, label int")
    rows = slim.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(max_docs).collect()
    return QualityModel.fit([r["text"].encode() for r in rows], [r["label"] for r in rows])


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", held_modulus: int = 3, held: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    slim = docs.select(quoted(docs, id_col).cast("long").alias("doc_id"), quoted(docs, text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = model.scores(texts(batch))
            ids = batch.column("doc_id")
            cols = [ids, pa.array([crc_mod_py(i, held_modulus) == held for i in ids.to_pylist()]), pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted"])

        return step

    return map_pieces(slim, make, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text is predicted 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    whole = docs.select(F.struct(*(quoted(docs, c) for c in docs.columns)).alias("row"), quoted(docs, text_col).cast("string").alias("text"))

    def make():
        model = shared.value
        return lambda batch: batch.filter(pa.array(model.scores(texts(batch)) >= 0.5)).select(["row"])

    return map_pieces(whole, make, T.StructType([whole.schema["row"]])).select("row.*")


def learn_default(spark: SparkSession, docs: DataFrame, sf_dir: str) -> QualityModel:
    """The model of the contract: labels of rows whose crc32(doc_id as text) mod 3 is not 1."""
    return fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn_default(spark, docs, sf_dir))
