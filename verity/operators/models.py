"""Training, scoring, artifacts and explanations of the two classifiers."""

from __future__ import annotations

import dataclasses
import json
import math
from collections.abc import Iterator

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verity.functions import scalars as S
from verity.operators import metrics

BACKENDS = {"gbt": GBTClassifier, "forest": RandomForestClassifier}


@dataclasses.dataclass(frozen=True)
class TrainConfig:
    backend: str = "gbt"  # the canonical one; training compares both but never picks by result
    trees: int = 20
    depth: int = 5
    seed: int = 42
    recall_floor: float | None = None


def guard(features: list[str], forbidden: list[str]) -> None:
    """Raise if a forbidden column is among the features."""
    if bad := sorted(set(features) & set(forbidden)):
        raise ValueError(f"forbidden features: {', '.join(bad)}")


def ordered(df: DataFrame, features: list[str], *keep: str) -> DataFrame:
    """Exactly the features in the manifest's order; raise if one is missing."""
    if missing := [c for c in features if c not in df.columns]:
        raise ValueError(f"missing features: {', '.join(missing)}")
    return df.select(*keep, *features)


def pipeline(features: list[str], backend: str, c: TrainConfig) -> Pipeline:
    """Missing values become the training median plus an indicator column; trees follow."""
    filled = [f"__filled_{f}" for f in features]
    model = BACKENDS[backend](featuresCol="__features__", labelCol="__y", weightCol="__w", maxDepth=c.depth, seed=c.seed)
    model = model.setMaxIter(c.trees) if backend == "gbt" else model.setNumTrees(c.trees)
    return Pipeline(stages=[Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=[*filled, *(f"__na_{f}" for f in features)], outputCol="__features__"), model])


def indicators(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({f: F.col(f).cast("double") for f in features}).withColumns({f"__na_{f}": (F.col(f).isNull() | F.isnan(f)).cast("double") for f in features})


def train(df: DataFrame, features: list[str], truth: str, c: TrainConfig = TrainConfig(), backend: str | None = None, forbidden: list[str] = ()) -> PipelineModel:
    """Fit on rows with a truth, positives weighted by negatives over positives."""
    guard(features, forbidden)
    rows = df.where(F.col(truth).isNotNull())
    weight = metrics.class_weight(rows, truth).first()["weight"]
    rows = rows.withColumn("__y", F.col(truth).cast("double")).withColumn("__w", F.when(F.col(truth), F.lit(float(weight))).otherwise(F.lit(1.0)))
    return pipeline(features, backend or c.backend, c).fit(indicators(rows, features))


def score(df: DataFrame, model: PipelineModel, features: list[str], name: str, threshold: float | None = None) -> DataFrame:
    """Add PROBA_<name> and PRED_<name>; no attaching by position."""
    out = model.transform(indicators(df, features)).withColumn(f"PROBA_{name}", vector_to_array("probability")[1])
    drop = [c for c in out.columns if c.startswith("__") or c in ("rawPrediction", "probability", "prediction")]
    return out.drop(*drop).withColumn(f"PRED_{name}", S.flagged(F.col(f"PROBA_{name}"), threshold))


def fit_all(train_rows: DataFrame, features: list[str], truth: str, c: TrainConfig = TrainConfig(), forbidden: list[str] = ()) -> dict[str, PipelineModel]:
    return {backend: train(train_rows, features, truth, c, backend, forbidden) for backend in BACKENDS}


def ranked(fitted: dict[str, PipelineModel], test_rows: DataFrame, features: list[str], truth: str) -> DataFrame:
    """Metrics of models on the test rows, best F1 first."""
    out = None
    for backend, model in fitted.items():
        scored = score(test_rows, model, features, "M").withColumn("__p", F.col("PRED_M") == 1)
        row = metrics.binary(scored, truth, "__p").crossJoin(metrics.roc_auc(scored, truth, "PROBA_M")).select(F.lit(backend).alias("backend"), "*")
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc("f1"), "backend")


def compare(train_rows: DataFrame, test_rows: DataFrame, features: list[str], truth: str, c: TrainConfig = TrainConfig()) -> DataFrame:
    """Metrics of both backends on the test rows, best F1 first."""
    return ranked(fit_all(train_rows, features, truth, c), test_rows, features, truth)


def importances(spark: SparkSession, model: PipelineModel, features: list[str], n: int = 20) -> DataFrame:
    """Top features by importance, an indicator counted with its feature."""
    v = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v[k] + v[k + len(features)])) for k, f in enumerate(features)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(n)


def parameters(model) -> dict[str, object]:
    """A fitted stage's parameters, safe for JSON (repr where not)."""
    out = {}
    for p, v in model.extractParamMap().items():
        out[p.name] = v if isinstance(v, bool | int | float | str | type(None)) else repr(v)
    return out


def save(spark: SparkSession, model: PipelineModel, folder: str, features: list[str], **more) -> None:
    model.write().overwrite().save(f"{folder}/model")
    text = json.dumps({"feature_columns": features, **more}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def load(spark: SparkSession, folder: str) -> tuple[PipelineModel, dict]:
    """Raises FileNotFoundError when a part of the artifact is absent."""
    try:
        manifest = json.loads(spark.read.text(f"{folder}/manifest").first()["value"])
        return PipelineModel.load(f"{folder}/model"), manifest
    except Exception as e:
        raise FileNotFoundError(f"no complete model artifact in {folder}") from e


# --- explanations ------------------------------------------------------------------------------------------


@dataclasses.dataclass
class Leaves:
    """All leaves of a tree ensemble: value, and for each the bounds and cover shares of the features on its path."""

    values: list[float]
    paths: list[list[tuple[int, float, float, float]]]  # feature, low < x <= high, share of the parent's rows kept
    expected: float


def leaves_of(model: PipelineModel, folder: str) -> Leaves:
    """Read the trees from the saved form of the last stage (numbers of nodes, not of rows)."""
    stage = model.stages[-1]
    spark = SparkSession.getActiveSession()
    stage.write().overwrite().save(folder)
    weights = list(stage.treeWeights)
    scale = 2.0 if isinstance(stage.trees[0].__class__.__name__, str) and "Regression" in stage.trees[0].__class__.__name__ else 1.0
    nodes: dict[int, dict[int, tuple]] = {}
    data = spark.read.parquet(f"{folder}/data")
    node = "nodeData" if "nodeData" in data.columns else None
    tree = "treeID" if "treeID" in data.columns else None
    for r in data.collect():
        n = r[node] if node else r
        nodes.setdefault(r[tree] if tree else 0, {})[n["id"]] = n
    out = Leaves([], [], 0.0)
    for t, found in nodes.items():
        w = weights[t] * scale / (1.0 if scale == 2.0 else sum(weights))

        def walk(i: int, path: dict, reach: float) -> None:
            n = found[i]
            if n["leftChild"] < 0:
                stats = n["impurityStats"]
                value = n["prediction"] if scale == 2.0 else stats[1] / max(sum(stats), 1e-300)
                out.values.append(w * value)
                out.paths.append([(f, lo, hi, z) for f, (lo, hi, z) in path.items()])
                out.expected += w * value * reach
                return
            f, cut = n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"][0]
            kids = [found[n["leftChild"]], found[n["rightChild"]]]
            total = sum(cover(k) for k in kids)
            for k, (child, low) in enumerate(((n["leftChild"], False), (n["rightChild"], True))):
                lo, hi, z = path.get(f, (-math.inf, math.inf, 1.0))
                share = cover(kids[k]) / total if total else 0.5
                walk(child, {**path, f: ((max(lo, cut), hi, z * share) if low else (lo, min(hi, cut), z * share))}, reach * share)

        walk(0, {}, 1.0)
    return out


def cover(node) -> float:
    """Weighted rows that reached a node."""
    stats = node["impurityStats"]
    return float(stats[0] if len(stats) == 3 else sum(stats))


def attributions(x: np.ndarray, leaves: Leaves) -> np.ndarray:
    """Path-dependent Shapley values of each row and feature, all rows of a batch at once.

    For a leaf with features j on its path, let o_j say whether x stays on the path and z_j be the share of training
    rows that does. A feature's part is the leaf's value times (o_i - z_i) times the sum over k of
    k! (m - 1 - k)! / m! times the k-th coefficient of the product over the other j of (z_j + o_j t).
    """
    out = np.zeros_like(x, dtype=np.float64)
    for value, path in zip(leaves.values, leaves.paths, strict=True):
        m = len(path)
        if not m or not value:
            continue
        f = [p[0] for p in path]
        o = np.stack([(x[:, j] > lo) & (x[:, j] <= hi) for j, lo, hi, _ in path], axis=1).astype(np.float64)
        z = np.array([p[3] for p in path])
        weight = np.array([math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)])
        for i in range(m):
            poly = np.zeros((len(x), m))
            poly[:, 0] = 1.0
            for j in range(m):
                if j != i:
                    moved = np.zeros_like(poly)
                    moved[:, 1:] = poly[:, :-1] * o[:, j : j + 1]
                    poly = poly * z[j] + moved
            out[:, f[i]] += value * (o[:, i] - z[i]) * (poly @ weight)
    return out


def shap(df: DataFrame, model: PipelineModel, features: list[str], key: str, folder: str) -> DataFrame:
    """(key, feature, value, shap) in long form; an indicator's part belongs to its feature. Trees are broadcast."""
    leaves = df.sparkSession.sparkContext.broadcast(leaves_of(model, folder))
    rows = Pipeline(stages=[]).fit(df).transform(df)
    assembled = PipelineModel(model.stages[:-1]).transform(indicators(rows, features)).select(key, *features, vector_to_array("__features__").alias("__a"))
    width = len(features)

    def run(frames: Iterator):
        import pandas as pd

        for f in frames:
            if not len(f):
                continue
            phi = attributions(np.stack(f["__a"].to_numpy()), leaves.value)
            phi = phi[:, :width] + phi[:, width : 2 * width]
            yield pd.DataFrame({key: np.repeat(f[key].to_numpy(), width), "feature": np.tile(features, len(f)), "value": f[features].to_numpy(np.float64).ravel(), "shap": phi.ravel()})

    kind = df.schema[key].dataType.simpleString()
    return assembled.mapInPandas(run, f"`{key}` {kind}, feature string, value double, shap double")


def grouped(shaps: DataFrame, key: str) -> DataFrame:
    """Signed sums by source column: (key, feature_group, shap, value); value only for groups of one feature."""
    group = S.base_column(F.col("feature")).alias("feature_group")
    one = F.when(F.count(F.lit(1)) == 1, F.first("value"))
    return shaps.groupBy(key, group).agg(F.sum("shap").alias("shap"), one.alias("value"))


def mean_abs(shaps: DataFrame, column: str) -> DataFrame:
    return shaps.groupBy(column).agg(F.avg(F.abs("shap")).alias("mean_abs_shap")).orderBy(F.desc("mean_abs_shap"), column)


def top_contributors(groups: DataFrame, key: str, n: int = 8) -> DataFrame:
    """The n largest contributions of each row, by size and then name, ranked from 1."""
    from verity.operators.derive import top_by

    return top_by(groups, [key], [F.desc(F.abs("shap")), F.asc("feature_group")], n)


def signatures(groups: DataFrame, assignment: DataFrame, key: str, cluster: str) -> DataFrame:
    """Mean signed contribution of each source column in each cluster."""
    return groups.join(assignment.select(key, cluster), key).groupBy(cluster, "feature_group").agg(F.avg("shap").alias("mean_shap"))
