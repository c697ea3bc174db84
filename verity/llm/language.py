"""Operator 4: language identification by interpolated Kneser-Ney character models.

One model per language: order-n counts at the top, continuation counts below, absolute discounting at each order,
a uniform floor. Each order is a sorted array of 64-bit hashes with log-probabilities and one of contexts with
log back-off weights. A text is folded to lower-case letters with single blanks between runs of them; its score
under a language is the mean log-probability of a character (length-normalised cross-entropy, negated), and the
language with the lowest cross-entropy wins. Confidence is a softmax over languages at a temperature calibrated on
a part of the training sample that the counts do not use. Rejection: `und` for a text without a letter, and, with
`reject` above 0, for one whose cross-entropy under the chosen language is beyond what the share `reject` of that
part's texts of the language have (the contract's query rejects nothing else).

Training is on the driver on a bounded sample: for each language at most `max_docs` rows, lowest hash of id and text
first (parameters of fit). Scoring is map-only; n-grams of a piece are looked up once each.

Nulls: a null or letterless text gives `und` with score 0; rows with a null lang or id are not learnt from; a null
id is not held out. With no training row every text is `und`. Rows are independent of each other. Ties go to the
first language in alphabetical order.
"""

from __future__ import annotations

import dataclasses
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verity.llm.common import crc_mod, crc_mod_py, map_pieces, quoted, table
from verity.llm.hashing import U, mix

BLANK = np.uint32(32)


#: Blanks before each text, so that no context reaches into another one; a model's order is at most one more.
PAD = 7


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, letters lower-cased and all else a single blank; and where each text begins.

    Each text begins with PAD blanks; its characters from begin + PAD to the next begin are predicted.
    """
    lowered = [t.lower() for t in texts]
    code = np.frombuffer("".join(["\n" * PAD + t for t in lowered]).encode("utf-32-le"), np.uint32)
    letter = _letters()[code]
    lengths = np.array([len(t) for t in lowered], np.int64)
    begin = np.cumsum(lengths + PAD) - lengths - PAD
    keep = letter | np.append(True, letter[:-1])
    for j in range(PAD):
        keep[begin + j] = True
    keep[(begin + PAD)[lengths > 0]] &= letter[(begin + PAD)[lengths > 0]]
    out = np.where(letter, code, BLANK)[keep]
    at = np.cumsum(keep) - 1
    return out, np.append(at[begin], len(out))


def grams(code: np.ndarray, order: int) -> np.ndarray:
    """Hash of the n-gram that ends at each place; places before the first whole one use what there is."""
    h = code.astype(U) + U(1)
    for j in range(1, order):
        h[j:] = h[j:] + mix(code[:-j].astype(U) + U((j << 40) + 1))
    return h


@dataclasses.dataclass
class Order:
    hash: np.ndarray  # sorted
    logp: np.ndarray
    context: np.ndarray  # sorted
    backoff: np.ndarray


class KneserNey:
    """Interpolated Kneser-Ney model of one language."""

    def __init__(self, texts: list[str], order: int = 5, discount: float = 0.75):
        code, begin = fold(texts)
        place = np.arange(len(code)) - np.repeat(begin[:-1], np.diff(begin))
        self.order, self.orders = order, []
        seen = np.flatnonzero(place >= PAD)  # the blanks in front are given
        letters = len(np.unique(code))
        self.floor = -np.log(letters + 1.0)
        below = None
        for n in range(1, order + 1):
            sample = seen
            if n < order:  # one place for each distinct n-gram with what precedes it
                sample = seen[np.unique(grams(code, n + 1)[seen], return_index=True)[1]]
            h, first, count = np.unique(grams(code, n)[sample], return_index=True, return_counts=True)
            where = sample[first]
            ctx = self.context(code, n)[where] if n > 1 else np.zeros(len(h), U)
            keys, inverse = np.unique(ctx, return_inverse=True)
            total = np.bincount(inverse, count, len(keys))
            kinds = np.bincount(inverse, minlength=len(keys))
            lam = discount * kinds / total
            under = np.exp(self.floor) if below is None else np.exp(below[where])
            p = (count - discount) / total[inverse] + lam[inverse] * under
            self.orders.append(Order(h, np.log(p), keys, np.log(lam)))
            below = self.places(code, n) if n < order else None

    @staticmethod
    def context(code: np.ndarray, n: int) -> np.ndarray:
        """Hash of the n - 1 characters before each place."""
        h = np.zeros(len(code), U)
        for j in range(1, n):
            h[j:] = h[j:] + mix(code[:-j].astype(U) + U((j << 40) + 1))
        return h

    def places(self, code: np.ndarray, upto: int | None = None) -> np.ndarray:
        """Log-probability of each character after the ones before it, by the orders so far."""
        return self.lookup([grams(code, n) for n in range(1, (upto or self.order) + 1)], [self.context(code, n) for n in range(1, (upto or self.order) + 1)])

    def lookup(self, hashes: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        logp = np.full(len(hashes[0]), self.floor)
        for n, (h, c) in enumerate(zip(hashes, contexts, strict=True)):
            o = self.orders[n]
            if not len(o.hash):
                continue
            if n:
                at = np.minimum(np.searchsorted(o.context, c), len(o.context) - 1)
                logp = logp + np.where(o.context[at] == c, o.backoff[at], 0.0)
            else:
                logp = logp + o.backoff[0]
            at = np.minimum(np.searchsorted(o.hash, h), len(o.hash) - 1)
            logp = np.where(o.hash[at] == h, o.logp[at], logp)
        return logp


class LanguageModel:
    def __init__(self, langs: list[str], models: list[KneserNey], scale: float):
        self.langs, self.models, self.scale = langs, models, scale
        self.calibration = [np.zeros(0)] * len(langs)  # mean log-probabilities of held texts under their own language

    @classmethod
    def fit(cls, samples: dict[str, list[str]], order: int = 5) -> LanguageModel:
        langs = sorted(samples)
        parts = {lang: ([t for i, t in enumerate(ts) if i % 5 != 4] or ts, [t for i, t in enumerate(ts) if i % 5 == 4]) for lang, ts in samples.items()}
        model = cls(langs, [KneserNey(parts[lang][0], order) for lang in langs], 1.0)
        held = [(t, k) for k, lang in enumerate(langs) for t in parts[lang][1]]
        if held and len(langs) > 1:
            means, _ = model.means([t for t, _ in held])
            truth = np.array([k for _, k in held])
            model.calibration = [np.sort(means[truth == k, k]) for k in range(len(langs))]
            best = np.inf
            for scale in (1.0, 2.0, 4.0, 8.0, 16.0, 32.0):
                loss = -np.log(_softmax(means * scale)[np.arange(len(held)), truth] + 1e-12).mean()
                if loss < best - 1e-4:
                    best, model.scale = loss, scale
        return model

    def means(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-probability of a character of each text under each language; which texts have a letter."""
        code, begin = fold(texts)
        order = self.models[0].order if self.models else 1
        _, first, inverse = np.unique(grams(code, order), return_index=True, return_inverse=True)
        hashes = [grams(code, n)[first] for n in range(1, order + 1)]
        contexts = [KneserNey.context(code, n)[first] for n in range(1, order + 1)]
        n = np.diff(begin) - PAD
        out = np.zeros((len(texts), len(self.models)))
        for k, m in enumerate(self.models):
            logp = m.lookup(hashes, contexts)[inverse]
            total = np.concatenate([[0.0], np.cumsum(logp)])
            out[:, k] = (total[begin[1:]] - total[begin[:-1] + PAD]) / np.maximum(n, 1)
        return out, np.array([any(map(str.isalpha, t)) for t in texts], bool)

    def limits(self, reject: float) -> np.ndarray:
        """Of each language the lowest mean log-probability that is not rejected."""
        return np.array([np.quantile(c, reject, method="lower") if reject > 0 and len(c) else -np.inf for c in self.calibration])

    def predict(self, texts: list[str], reject: float = 0.0) -> tuple[list[str], np.ndarray]:
        if not self.models:
            return ["und"] * len(texts), np.zeros(len(texts))
        means, some = self.means(texts)
        p = _softmax(means * self.scale)
        best, top = p.argmax(1), p.max(1)
        ok = some & (means[np.arange(len(texts)), best] >= self.limits(reject)[best])
        return [self.langs[b] if o else "und" for b, o in zip(best.tolist(), ok.tolist(), strict=True)], np.where(some, top, 0.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(docs: DataFrame, where, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 250, max_bytes: int = 50_000) -> LanguageModel:
    """Learn every language that is there, each from at most max_docs rows; texts of more than max_bytes are taken
    only where a language has fewer shorter ones, and then their first max_bytes characters."""
    slim = docs.select(quoted(docs, id_col).cast("long").alias("doc_id"), quoted(docs, lang_col).cast("string").alias("lang"), quoted(docs, text_col).cast("string").alias("text"))
    slim = slim.where(where & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    slim = slim.withColumn("long", F.octet_length("text") > max_bytes).withColumn("h", F.xxhash64("doc_id", "text"))
    # The lowest hashes of each language: below a bound that leaves about four times as many as are wanted, so that
    # no task sees more than a bounded part of a language. Rows that repeat are one.
    counts = slim.groupBy("lang", "long").agg(F.approx_count_distinct("h").alias("n")).collect()
    bounds = docs.sparkSession.createDataFrame([(r["lang"], r["long"], -(2**63) + min(2**64 - 1, (2**64 * (4 * max_docs + 64)) // max(1, r["n"]))) for r in counts], "lang string, long boolean, bound long")
    few = slim.join(F.broadcast(bounds), ["lang", "long"]).where("h <= bound").groupBy("lang", "long", "h").agg(F.min("doc_id").alias("doc_id"), F.first(F.substring("text", 1, max_bytes)).alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("long", "h", "doc_id"))
    rows = few.withColumn("rank", rank).where(F.col("rank") <= max_docs).collect() if counts else []
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"], r["text"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    return LanguageModel.fit(samples)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", held_modulus: int = 4, held: int = 2, reject: float = 0.0) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score."""
    slim = docs.select(quoted(docs, id_col).cast("long").alias("doc_id"), quoted(docs, text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column("doc_id")
            langs, score = model.predict([t or "" for t in batch.column("text").to_pylist()], reject)
            held_out = [crc_mod_py(i, held_modulus) == held for i in ids.to_pylist()]
            return pa.RecordBatch.from_arrays([ids, pa.array(held_out), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

        return step

    return map_pieces(slim, make, "doc_id long, held_out boolean, lang_pred string, score double")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs, crc_mod("doc_id", 4) != 2))
