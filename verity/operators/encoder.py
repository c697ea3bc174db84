"""Text encoders and the dictionary of vectors: each distinct text is encoded once."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verity.operators.derive import dictionary, uncovered


class Encoder(Protocol):
    """Turns sentences into unit vectors; made once in a worker by `open`."""

    dim: int

    def open(self) -> Encoder: ...

    def encode(self, sentences: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """Deterministic stand-in without weights: signed hashes of character trigrams, scaled to length one."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def open(self) -> HashingEncoder:
        return self

    def encode(self, sentences: list[str]) -> np.ndarray:
        out = np.zeros((len(sentences), self.dim), np.float64)
        for row, s in enumerate(sentences):
            padded = f"\x02{s}\x03"
            for k in range(len(padded) - 2):
                h = int.from_bytes(hashlib.blake2b(padded[k : k + 3].encode(), digest_size=8).digest(), "little")
                out[row, h % self.dim] += 1.0 if h >> 63 else -1.0
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


#: An exported model's files, the preferred one first (8-bit weights for processors, else full ones), and
#: the name of an output that is one vector a sentence.
WEIGHTS, WHOLE_SENTENCE = ("model_int8.onnx", "model_quantized.onnx", "model.onnx"), "sentence_embedding"


def weights_in(folder: str, preferred: tuple[str, ...] = WEIGHTS) -> str:
    """The first of the preferred weights that a folder has, itself or under onnx/; nothing is downloaded."""
    for name in preferred:
        for path in (os.path.join(folder, name), os.path.join(folder, "onnx", name)):
            if os.path.exists(path):
                return path
    raise FileNotFoundError(f"none of {', '.join(preferred)} in {folder}")


class OnnxEncoder:
    """A transformer from an ONNX file (or a folder of weights, which every worker sees) and a tokenizers JSON: the
    model's sentence vector if it has one, else a masked mean (or the first token); unit length.

    Sentences run longest together, so that a batch pads little, and come back in their own order. In the mode
    per_batch each batch is tokenised by itself in the order given: less memory, more padding, equal vectors.
    """

    def __init__(self, model_file: str, tokenizer_file: str, dim: int, max_tokens: int = 512, batch: int = 32, pooling: str = "mean", mode: str = "single_pass"):
        if mode not in ("single_pass", "per_batch"):
            raise ValueError(f"unknown mode {mode!r}")
        self.model_file, self.tokenizer_file, self.dim, self.max_tokens, self.batch, self.pooling, self.mode = model_file, tokenizer_file, dim, max_tokens, batch, pooling, mode
        self.session = self.tokenizer = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"session": None, "tokenizer": None}  # opened anew where it arrives

    def open(self) -> OnnxEncoder:
        if self.session is None:
            import onnxruntime
            from tokenizers import Tokenizer

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = 1
            weights = weights_in(self.model_file) if os.path.isdir(self.model_file) else self.model_file
            self.session = onnxruntime.InferenceSession(weights, options, providers=["CPUExecutionProvider"])
            self.tokenizer = Tokenizer.from_file(self.tokenizer_file)
            self.tokenizer.enable_truncation(self.max_tokens)
        return self

    def encode(self, sentences: list[str]) -> np.ndarray:
        if self.mode == "per_batch":
            return np.concatenate([np.zeros((0, self.dim), np.float32), *(self._run(sentences[a : a + self.batch]) for a in range(0, len(sentences), self.batch))])
        return self._run(sentences)

    def _run(self, sentences: list[str]) -> np.ndarray:
        coded = [e.ids for e in self.tokenizer.encode_batch(sentences)]
        order = np.argsort([-len(c) for c in coded], kind="stable")
        out = np.zeros((len(sentences), self.dim), np.float32)
        names = {i.name for i in self.session.get_inputs()}
        outputs = [o.name for o in self.session.get_outputs()]
        wanted = WHOLE_SENTENCE if WHOLE_SENTENCE in outputs else outputs[0]
        for a in range(0, len(order), self.batch):
            at = order[a : a + self.batch]
            width = max(len(coded[i]) for i in at)
            ids = np.array([coded[i] + [0] * (width - len(coded[i])) for i in at], np.int64)
            mask = np.array([[1] * len(coded[i]) + [0] * (width - len(coded[i])) for i in at], np.int64)
            feed = {k: v for k, v in (("input_ids", ids), ("attention_mask", mask), ("token_type_ids", np.zeros_like(ids))) if k in names}
            got = self.session.run([wanted], feed)[0]
            out[at] = unit(got) if got.ndim == 2 else pooled(got, mask, self.pooling)
        return out


def describe(encoder: Encoder) -> dict:
    """What a manifest keeps of an encoder, so that a later table is encoded alike."""
    names = {"HashingEncoder": ("dim",), "OnnxEncoder": ("model_file", "tokenizer_file", "dim", "max_tokens", "batch", "pooling", "mode")}
    kind = type(encoder).__name__
    return {"kind": kind, **{k: getattr(encoder, k) for k in names.get(kind, ())}}


def from_description(d: dict) -> Encoder:
    kinds = {"HashingEncoder": HashingEncoder, "OnnxEncoder": OnnxEncoder}
    if d.get("kind") not in kinds:
        raise ValueError(f"unknown encoder {d.get('kind')!r}: pass one")
    return kinds[d["kind"]](**{k: v for k, v in d.items() if k != "kind"})


def pooled(hidden: np.ndarray, mask: np.ndarray, how: str = "mean") -> np.ndarray:
    """Masked mean (or first token) of hidden states, scaled to length one."""
    return unit(hidden[:, 0] if how == "first" else (hidden * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1), 1)[:, None])


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def encode_texts(texts: DataFrame, encoder: Encoder, column: str = "text", name: str = "vector") -> DataFrame:
    """Add a vector column with an iterator UDF: the encoder is opened once for each task."""

    @F.pandas_udf("array<float>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ready = encoder.open()
        for batch in batches:
            yield pd.Series(list(ready.encode(batch.tolist())) if len(batch) else [], index=batch.index, dtype=object)

    return texts.withColumn(name, apply(F.col(column)))


def build(df: DataFrame, columns: list[str], encoder: Encoder) -> DataFrame:
    """(col, text, n, vector) of all distinct texts."""
    return encode_texts(dictionary(df, columns), encoder)


def refresh(df: DataFrame, columns: list[str], encoder: Encoder, known: DataFrame | None = None, force: bool = False) -> DataFrame:
    """A dictionary that covers df: only texts that the known one lacks are encoded; counts are those of df."""
    if known is None or force:
        return build(df, columns, encoder)
    counts = dictionary(df, columns)
    new = encode_texts(uncovered(df, known, columns), encoder)
    vectors = known.select("col", "text", "vector").unionByName(new.select("col", "text", "vector"))
    return counts.join(vectors, ["col", "text"])
