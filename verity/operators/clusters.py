"""Error archetypes: standardised vectors, k-means with several seeds, silhouette, and the whole report."""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verity.operators import crosstab as X
from verity.sources.folders import kept, scratch


def standardised(df: DataFrame, vector: str, name: str) -> DataFrame:
    """Each place of a vector with mean 0 and population standard deviation 1 (constant places become 0)."""
    cells = df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()
    m, s = (F.array(*(F.lit(float(r[c])) for r in cells)) for c in ("m", "s"))
    shift = F.zip_with(F.zip_with(F.col(vector), m, lambda x, y: x.cast("double") - y), s, lambda d, z: F.when(z > 1e-12, d / z).otherwise(F.lit(0.0)))
    return df.withColumn(name, shift)


def kmeans(df: DataFrame, vector: str, k: int, name: str, seeds: int = 10, seed: int = 42) -> DataFrame:
    """Add cluster numbers: of several starts the one with the lowest cost; k of 1 is one cluster."""
    if k < 2:
        return df.withColumn(name, F.lit(0))
    rows = df.withColumn("__x", array_to_vector(F.col(vector).cast("array<double>")))
    held = rows.select("__x").persist()
    best = min((KMeans(k=k, seed=seed + s, featuresCol="__x", predictionCol=name).fit(held) for s in range(seeds)), key=lambda m: m.summary.trainingCost)
    held.unpersist()
    return best.transform(rows).drop("__x")


def silhouette(df: DataFrame, vector: str, cluster: str, block: int = 2048) -> float | None:
    """Mean Euclidean silhouette over all rows; None for a single cluster.

    Rows are packed in blocks, and each pair of blocks gives the sums of distances of one block's rows to the clusters
    of the other. The work is the square of the rows; what is sent is a number for each row, cluster and pair of blocks.
    """
    rows = df.select(F.col(vector).cast("array<double>").alias("x"), F.col(cluster).cast("int").alias("c"))
    sizes = {r["c"]: r["count"] for r in rows.groupBy("c").count().collect()}
    if len(sizes) < 2:
        return None
    kinds = np.array(sorted(sizes))
    total = np.array([sizes[k] for k in kinds.tolist()], float)

    def pack(batches):
        part, held, n = TaskContext.get().partitionId(), [], 0

        def packed(held, n):
            t = pa.Table.from_batches(held).combine_chunks()
            x = t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | n]), pa.array([x.tobytes()], pa.binary()), pa.array([t.column("c").to_numpy().astype(np.int32).tobytes()], pa.binary())], ["i", "x", "c"])

        waiting = 0
        for b in batches:
            for at in range(0, b.num_rows, block):
                piece = b.slice(at, block)
                if waiting + piece.num_rows > block:
                    yield packed(held, n)
                    held, waiting, n = [], 0, n + 1
                held.append(piece)
                waiting += piece.num_rows
        if waiting:
            yield packed(held, n)

    def of(row: dict) -> tuple[np.ndarray, np.ndarray]:
        c = np.searchsorted(kinds, np.frombuffer(row["c"], np.int32))
        return np.frombuffer(row["x"], float).reshape(len(c), -1), c

    def distances(batches):
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                (x, c), (y, d) = of(r), of({"x": r["y"], "c": r["d"]})
                near = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0))
                if r["i"] == r["j"]:
                    np.fill_diagonal(near, 0)
                sums = near @ (d[:, None] == np.arange(len(kinds)))
                yield pa.RecordBatch.from_arrays([pa.array([r["i"]]), pa.array([sums.tobytes()], pa.binary()), pa.array([c.astype(np.int32).tobytes()], pa.binary())], ["i", "sums", "own"])

    def scores(batches):
        found: dict[int, list] = {}
        for b in batches:
            for r in b.to_pylist():
                own = np.frombuffer(r["own"], np.int32)
                sums = np.frombuffer(r["sums"], float).reshape(len(own), -1)
                if r["i"] in found:
                    found[r["i"]][0] += sums
                else:
                    found[r["i"]] = [sums.copy(), own]
        for sums, own in found.values():
            at = np.arange(len(own))
            a = sums[at, own] / np.maximum(total[own] - 1, 1)
            other = sums / total
            other[at, own] = np.inf
            b = other.min(1)
            s = np.where(total[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
            yield pa.RecordBatch.from_arrays([pa.array([float(s.sum())]), pa.array([len(s)])], ["s", "n"])

    blocks = max(1, -(-int(total.sum()) // block))
    folder = scratch(df.sparkSession)
    rows.repartition(blocks).mapInArrow(pack, "i long, x binary, c binary").write.parquet(folder)
    left = df.sparkSession.read.parquet(folder)
    pairs = left.crossJoin(left.select(F.col("i").alias("j"), F.col("x").alias("y"), F.col("c").alias("d")))
    part = pairs.mapInArrow(distances, "i long, sums binary, own binary").repartition(blocks, "i").mapInArrow(scores, "s double, n long")
    got = part.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    return got["s"] / got["n"]


def choose_k(df: DataFrame, vector: str, key: str, low: int = 2, high: int = 8, n: int | None = None, seeds: int = 10) -> int:
    n = n if n is not None else df.count()
    best = (-2.0, 1)
    for k in range(low, min(high, n - 1) + 1):
        s = silhouette(kmeans(df, vector, k, "__k", seeds), vector, "__k")
        if s is not None and s > best[0]:
            best = (s, k)
    return best[1]


@dataclasses.dataclass
class Report:
    """groups: numbered once, by their whole paths; `path` is cut at the first weak value, `whole` is not."""

    n_errors: int
    skipped: bool
    groups: DataFrame | None = None
    assignments: DataFrame | None = None
    table: DataFrame | None = None
    stats: DataFrame | None = None
    passed: DataFrame | None = None  # all columns that pass the gate, split on or not, by rank
    modes: DataFrame | None = None
    weak: DataFrame | None = None  # reasons that do not pass
    described: dict[str, DataFrame] = dataclasses.field(default_factory=dict)


def report(errors: DataFrame, key: str, way: str, columns: list[str], cluster: str, config: X.Config = X.Config(), excluded: tuple[str, ...] = (), signatures: DataFrame | None = None, describe_under: dict[str, str] | None = None) -> Report:
    """Cross-tabs, drivers, value groups and assignments of error rows that carry a cluster; all values and bins come
    from the error rows alone. Fewer than min_rows error rows are not reported on.

    signatures: (cluster, feature_group, mean_shap), from which the reasons come that are named as not important.
    describe_under: a column (it may be an excluded one) to count under the nodes of a driver column.
    """
    n = errors.count()
    if n < config.min_rows:
        return Report(n, True)
    describe_under = describe_under or {}
    columns = X.lineage(errors, columns, list(excluded))
    beside = [c for c in describe_under if c in errors.columns and c not in columns]
    rows = kept(X.with_values(errors, columns, config.bins).select(*dict.fromkeys([key, way, cluster, *columns, *beside])))
    table = kept(X.top_values(X.crosstab(rows, cluster, columns), config.top_values))
    stats = X.column_stats(table, config.min_group)
    passed = X.drivers(stats, config.importance, len(columns), excluded)
    picked = passed.where(F.col("rank") <= config.max_split)
    whole = X.capped(X.value_groups(rows, cluster, way, columns, picked, config), config.max_groups)
    groups = kept(X.truncated(whole, table, config.importance).withColumn("share", F.round(F.col("size") / F.lit(n), 4)))
    found = X.assigned(rows, cluster, way, columns, picked, whole)
    weak = X.not_important(X.reasons(signatures), stats, config.importance, excluded) if signatures is not None else None
    under = {c: X.described(found, groups, c, d, config.top_values) for c, d in describe_under.items() if c in rows.columns}
    return Report(n, False, groups, found, table, stats, passed, X.mode_values(rows, cluster, columns), weak, under)


def as_json(r: Report, config: X.Config = X.Config()) -> dict:
    """The report as nested values: what is collected is at most max_groups groups and some numbers for each cluster,
    column and frequent value."""
    if r.skipped:
        return {"n_errors": r.n_errors, "skipped": f"fewer than {config.min_rows} error rows"}
    enrichment = {(t["cluster"], t["col"], t["value"]): t["enrichment"] for t in r.table.collect()}
    stats = {(t["cluster"], t["col"]): {k: t[k] for k in ("max", "mean", "sum")} for t in r.stats.collect()}
    mode = {(t["cluster"], t["col"]): t["value"] for t in r.modes.collect()}
    passed, weak, under = {}, {}, {}
    for t in sorted(r.passed.collect(), key=lambda t: t["rank"]):
        passed.setdefault(t["cluster"], []).append(t["col"])
    for t in sorted(r.weak.collect(), key=lambda t: t["rank"]) if r.weak is not None else []:
        weak.setdefault(t["cluster"], []).append({"column": t["col"], "total_enrichment": stats[t["cluster"], t["col"]]})
    for column, found in r.described.items():
        for t in found.collect():
            under.setdefault((t["cluster"], t["direction"], t["node"]), {}).setdefault(column, {})[t["value"]] = t["count"]
    rows, out = sorted(r.groups.collect(), key=lambda g: g["group_no"]), []
    for g in rows:
        c, pinned = g["cluster"], dict(step.split("=", 1) for step in g["whole"])
        drivers = [{"column": col, "total_enrichment": stats[c, col], "value": value, "value_enrichment": round(enrichment.get((c, col, value), 0.0), 4)} for col in passed.get(c, []) for value in [pinned.get(col, mode.get((c, col)))] if value is not None]
        out.append({"group": g["group_no"], "archetype": c, "size": g["size"], "share": g["share"], "error_direction_mix": {g["direction"]: g["size"]}, "main_drivers": drivers, "not_important": weak.get(c, [])})
    trees = {c: tree_json([{**g.asDict(), "cluster": c} for g in rows if g["cluster"] == c], under=under) for c in sorted({g["cluster"] for g in rows})}
    main = {t["cluster"]: t["direction"] for t in dominant(r.groups).collect()}
    return {"n_errors": r.n_errors, "groups": out, "archetypes": [{"archetype": c, "direction": main[c], "tree": tree} for c, tree in trees.items()]}


def dominant(groups: DataFrame) -> DataFrame:
    """The most frequent direction of each cluster; ties by name."""
    per = groups.groupBy("cluster", "direction").agg(F.sum("size").alias("n"))
    return per.groupBy("cluster").agg(F.max_by("direction", F.struct("n", "direction")).alias("direction"))


def tree_json(rows: list[dict], depth: int = 0, under: dict | None = None) -> list[dict]:
    """Nested nodes of at most max_groups groups, for a JSON artifact: a group that ends above others keeps its own
    rows next to its children."""
    out: dict[tuple, list[dict]] = {}
    for r in rows:
        steps = [r["direction"], *r["path"]]
        out.setdefault(tuple(steps[depth : depth + 1]), []).append(r)
    nodes = []
    for step, members in out.items():
        if not step:
            continue
        ends = [r for r in members if len(r["path"]) == depth]
        below = [r for r in members if len(r["path"]) > depth]
        node: dict = {"step": step[0], "rows": sum(r["size"] for r in members)}
        if ends:
            node["group"], node["own_rows"] = ends[0].get("group_no"), sum(r["size"] for r in ends)
        if depth and (counts := (under or {}).get((members[0].get("cluster"), members[0]["direction"], " / ".join(members[0]["path"][:depth])))):
            node["described"] = counts
        if below:
            node["children"] = tree_json(below, depth + 1, under)
        nodes.append(node)
    return sorted(nodes, key=lambda n: (-n["rows"], n["step"]))
