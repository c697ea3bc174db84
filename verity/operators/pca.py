"""Frequency-weighted principal components, reduction strategies and their artifacts."""

from __future__ import annotations

import dataclasses
import json
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Caps on components for the usual variance targets, and for any other.
K_MAX_FOR = {0.90: 32, 0.95: 64, 0.99: 128}
K_MAX = 128


@dataclasses.dataclass(frozen=True)
class Strategy:
    name: str
    mode: str  # fixed, adaptive or raw
    fixed_k: int | None = None
    variance_target: float | None = None
    k_max: int | None = None
    k_min: int = 1


def parse_strategy(spec: str, k_max: int | None = None) -> Strategy:
    """pc1, pcN or topN; adaptive_V with 0 < V <= 1; raw."""
    text = spec.strip().lower()
    if text == "raw":
        return Strategy("raw", "raw")
    if m := re.fullmatch(r"(pc|top)([1-9]\d*)", text):
        k = int(m[2])
        return Strategy("pc1" if k == 1 else f"top{k}", "fixed", fixed_k=k, k_max=k_max)
    if (m := re.fullmatch(r"adaptive_(\d*\.?\d+)", text)) and 0 < (v := float(m[1])) <= 1:
        return Strategy(f"adaptive_{v:.2f}", "adaptive", variance_target=v, k_max=k_max or K_MAX_FOR.get(round(v, 2), K_MAX))
    raise ValueError(f"unknown reduction strategy: {spec!r}")


def feature_names(column: str, k: int, raw: bool = False) -> list[str]:
    return [f"{column}_EMB_DIM{i:03d}" for i in range(k)] if raw else [f"{column}_EMB_PC{i}" for i in range(1, k + 1)]


def gram(df: DataFrame, vector: str, weight: str | None = None, by: list[str] = ()) -> DataFrame:
    """(by..., n, s, g): summed weights, weighted sum and weighted outer products of vectors.

    Each task adds its rows up in numpy and sends one row for each key, so the shuffle is tasks times dim squared.
    """
    keys = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by)
    slim = df.select(*by, F.col(vector).cast("array<double>").alias("__v"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w")).where("__v IS NOT NULL AND __w > 0")

    def run(frames):
        import pandas as pd

        acc: dict[tuple, list] = {}
        for f in frames:
            for key, part in f.groupby(list(by), dropna=False, sort=False) if by else [((), f)]:
                if not len(part):
                    continue
                x, w = np.stack(part["__v"].to_numpy()), part["__w"].to_numpy()
                new = [w.sum(), w @ x, (x * w[:, None]).T @ x]
                acc[key] = [a + b for a, b in zip(acc[key], new, strict=True)] if key in acc else new
        for key, (n, s, g) in acc.items():
            yield pd.DataFrame([[*key, n, s.tolist(), g.ravel().tolist()]], columns=[*by, "n", "s", "g"])

    parts = slim.mapInPandas(run, f"{keys + ', ' if keys else ''}n double, s array<double>, g array<double>")
    # Sums of arrays place by place, without one long list of partial results in a task.
    long = parts.select(*by, "n", F.posexplode(F.concat("s", "g")).alias("i", "x"))
    total = long.groupBy(*by, "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return total.groupBy(*by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("sg"))


@dataclasses.dataclass
class Axes:
    """What a fit leaves behind: mean, axes (k, dim), all variance ratios, and whether a target was met."""

    mean: np.ndarray
    axes: np.ndarray
    ratios: np.ndarray
    target_met: bool | None = None

    @property
    def k(self) -> int:
        return len(self.axes)

    def project(self, x: np.ndarray, raw: bool = False) -> np.ndarray:
        return x if raw else (x - self.mean) @ self.axes.T


def solve(n: float, s: np.ndarray, g: np.ndarray, strategy: Strategy, tolerance: float = 1e-10) -> Axes:
    """Components of the weighted covariance (normalised by the weights' sum); the largest coordinate of an axis is
    positive. Rank counts eigenvalues above a share of the largest; a column without variance has no components."""
    mean = s / n
    values, vectors = np.linalg.eigh(g / n - np.outer(mean, mean))
    order = values.argsort()[::-1]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    rank = int((values > max(values[0], 0) * tolerance).sum()) if values[0] > 1e-15 * max(1.0, float(np.trace(g / n))) else 0
    total = values.sum()
    ratios = values / total if total > 0 else values
    if strategy.mode == "raw" or not rank:
        return Axes(mean.astype(np.float32), np.zeros((0, len(mean)), np.float32), ratios)
    limit = min(strategy.k_max or rank, rank)
    met = None
    if strategy.mode == "fixed":
        k = max(strategy.k_min, min(strategy.fixed_k, limit))
    else:
        run = np.cumsum(ratios)
        k = min(max(int(np.argmax(run >= strategy.variance_target - 1e-12)) + 1 if run[-1] >= strategy.variance_target - 1e-12 else rank, strategy.k_min), limit)
        met = bool(run[k - 1] >= strategy.variance_target - 1e-9)
    axes = vectors[:, : min(k, rank)].T
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(1)[:, None], 1) < 0, -1, 1)
    return Axes(mean.astype(np.float32), axes.astype(np.float32), ratios, met)


def fit(df: DataFrame, vector: str, strategy: Strategy, weight: str | None = None) -> Axes:
    row = gram(df, vector, weight).first()
    sg = np.array(row["sg"])
    dim = int((np.sqrt(1 + 4 * len(sg)) - 1) / 2)
    return solve(row["n"], sg[:dim], sg[dim:].reshape(dim, dim), strategy)


def fit_by(df: DataFrame, key: str, vector: str, strategy: Strategy, weight: str | None = None) -> dict[str, Axes]:
    """One fit for each value of key (the text columns: a few), all in one job."""
    out = {}
    for row in gram(df, vector, weight, [key]).collect():
        sg = np.array(row["sg"])
        dim = int((np.sqrt(1 + 4 * len(sg)) - 1) / 2)
        out[row[key]] = solve(row["n"], sg[:dim], sg[dim:].reshape(dim, dim), strategy)
    return out


def project(df: DataFrame, vector: str, axes: Axes, name: str, raw: bool = False) -> DataFrame:
    """Add the projection of a vector column as array<float>; Arrow batches, one matrix product each."""
    from pyspark.sql.functions import pandas_udf

    a, m = axes.axes, axes.mean

    @pandas_udf("array<float>")
    def apply(v):
        import pandas as pd

        ok = v.notna().to_numpy()
        out = np.full(len(v), None, object)
        if ok.any():
            x = np.stack(v[ok].to_numpy()).astype(np.float64)
            for i, row in zip(np.flatnonzero(ok), (x if raw else (x - m) @ a.T.astype(np.float64)).astype(np.float32), strict=True):
                out[i] = row
        return pd.Series(out)

    return df.withColumn(name, apply(F.col(vector)))


def artifact_rows(spark: SparkSession, fits: dict[str, Axes]) -> DataFrame:
    """(col, i, axis, ratio): i = 0 holds the mean."""
    rows = [(c, i, [float(x) for x in v], r) for c, a in fits.items() for i, v, r in [(0, a.mean, None), *((j + 1, v, float(a.ratios[j])) for j, v in enumerate(a.axes))]]
    return spark.createDataFrame(rows, "col string, i int, axis array<float>, ratio double")


def save(spark: SparkSession, fits: dict[str, Axes], strategy: Strategy, folder: str) -> None:
    artifact_rows(spark, fits).coalesce(1).write.mode("overwrite").parquet(f"{folder}/axes")
    manifest = {"strategy": dataclasses.asdict(strategy), "embed_cols": sorted(fits), "per_column": {c: {"k": a.k, "achieved_cumulative_variance": float(a.ratios[: a.k].sum()), "ratios": a.ratios[: a.k].tolist()} for c, a in fits.items()}}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def load(spark: SparkSession, folder: str) -> tuple[Strategy, dict[str, Axes]]:
    """Saved axes; a folder without a strategy in its manifest counts as pc1, as does the older layout of one file for
    each column, <folder>/<column>.json with mean, axis and ratio."""
    try:
        manifest = json.loads(spark.read.text(f"{folder}/manifest").first()["value"])
    except Exception:
        old = spark.read.text(f"{folder}/*.json", wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("f"), "value").collect()
        parsed = {r["f"].removesuffix(".json"): json.loads(r["value"]) for r in old}
        return parse_strategy("pc1"), {c: Axes(np.array(v["mean"], np.float32), np.array([v["axis"]], np.float32), np.array([v["ratio"]])) for c, v in parsed.items()}
    strategy = Strategy(**manifest["strategy"]) if "strategy" in manifest else parse_strategy("pc1")
    fits: dict[str, Axes] = {}
    found = spark.read.parquet(f"{folder}/axes").orderBy("col", "i").collect()  # a few vectors a column
    for c in manifest["embed_cols"]:
        mine = [r for r in found if r["col"] == c]
        axes = np.array([r["axis"] for r in mine if r["i"]], np.float32).reshape(len(mine) - 1, -1)
        fits[c] = Axes(np.array(mine[0]["axis"], np.float32), axes, np.array([r["ratio"] for r in mine if r["i"]]))
    return strategy, fits


def report(spark: SparkSession, fits: dict[str, Axes], n: int = 5) -> DataFrame:
    """(col, component, ratio, cumulative) of the first n components of each column."""
    rows = [(c, k + 1, float(a.ratios[k]), float(a.ratios[: k + 1].sum())) for c, a in sorted(fits.items()) for k in range(min(n, len(a.ratios)))]
    return spark.createDataFrame(rows, "col string, component int, ratio double, cumulative double")


def complete(spark: SparkSession, folder: str, strategy: Strategy, columns: list[str]) -> bool:
    """Whether saved axes fit the strategy and cover the columns, so that no new fit is needed."""
    try:
        saved, fits = load(spark, folder)
    except Exception:
        return False
    return saved == strategy and set(columns) <= set(fits)
