"""Bins, cross-tabs with enrichment, archetype statistics, value groups and their tree."""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verity.functions import scalars as S
from verity.operators.derive import top_by


@dataclasses.dataclass(frozen=True)
class Config:
    """Fixed values of the clustering report."""

    min_rows: int = 20
    bins: int = 5
    top_values: int = 20
    importance: float = 2.0
    min_group: int = 20
    max_split: int = 6
    max_groups: int = 200
    top_reasons: int = 6


def bin_edges(df: DataFrame, column: str, bins: int) -> list[float] | None:
    """Inner edges of equal-frequency bins without repeats; None if the column has at most `bins` values."""
    few = df.select(column).distinct().limit(bins + 1).count() <= bins
    if few:
        return None
    found = percentiles(df, column, [i / bins for i in range(1, bins)])
    return sorted(set(found)) if found else None


def percentiles(df: DataFrame, column: str, shares: list[float], few: int = 20_000) -> list[float]:
    """Exact percentiles, interpolated between neighbours; empty without a value.

    A rank is bracketed by approximate percentiles and counted again inside, until few distinct values are left: no
    task or driver holds more than those, whatever the rows.
    """
    values = df.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    n = values.count()
    if not n:
        return []
    places = [s * (n - 1) for s in shares]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    at = dict(zip(ranks, _of_rank(values, n, ranks, few), strict=True))
    return [at[math.floor(p)] + (at[math.ceil(p)] - at[math.floor(p)]) * (p - math.floor(p)) for p in places]


def _of_rank(values: DataFrame, n: int, ranks: list[int], few: int) -> list[float]:
    """The values of ascending ranks (from 0) among n values x."""
    if values.groupBy("x").count().limit(few + 1).count() <= few:
        found, before, out = values.groupBy("x").count().orderBy("x").collect(), 0, []
        for r in found:
            before += r["count"]
            while len(out) < len(ranks) and ranks[len(out)] < before:
                out.append(r["x"])
        return out
    accuracy, out = 1000, []
    for rank in ranks:
        low, high = max(0.0, rank / n - 2 / accuracy), min(1.0, (rank + 1) / n + 2 / accuracy)
        a, b = values.agg(F.percentile_approx("x", [low, high], accuracy)).first()[0]
        counts = values.agg(F.count_if(F.col("x") < a).alias("below"), F.count_if(F.col("x") <= b).alias("upto")).first()
        a, below = (a, counts["below"]) if counts["below"] <= rank else (None, 0)
        inside = values if a is None else values.where(F.col("x") >= a)
        inside, size = (inside.where(F.col("x") <= b), counts["upto"] - below) if counts["upto"] > rank else (inside, n - below)
        if size == n:  # nothing was cut off: take the value that half of them are below
            middle = values.agg(F.percentile_approx("x", 0.5, 100_000)).first()[0]
            least = values.agg(F.count_if(F.col("x") < middle).alias("less"), F.count_if(F.col("x") <= middle).alias("upto")).first()
            if least["less"] <= rank < least["upto"]:
                out.append(middle)
                continue
            below, inside, size = (0, values.where(F.col("x") < middle), least["less"]) if rank < least["less"] else (least["upto"], values.where(F.col("x") > middle), n - least["upto"])
        out += _of_rank(inside, size, [rank - below], few)
    return out


def bin_index(column: str, edges: list[float]) -> Column:
    """Bin of a value; a bin is closed on the right, equal values share one; null for null."""
    c = F.col(column)
    return F.when(c.isNotNull(), sum(((c > F.lit(e)).cast("int") for e in edges), F.lit(0)))


def lineage(df: DataFrame, configured: list[str] | None, excluded: list[str]) -> list[str]:
    """Columns to cross with: the configured ones that exist, else all, without the excluded."""
    chosen = [c for c in configured if c in df.columns] if configured else df.columns
    return [c for c in dict.fromkeys(chosen) if c not in set(excluded)]


def value_of(df: DataFrame, column: str, bins: int) -> Column:
    """A column as cross-tab values: numbers by bin where they have many values, times by day, null as a word."""
    kind = df.schema[column].dataType
    if S.is_time(kind):
        return S.text_or(F.to_date(column), S.NULL_VALUE)
    if S.is_number(kind) and (edges := bin_edges(df, column, bins)) is not None:
        return S.text_or(bin_index(column, edges), S.NULL_VALUE)
    return S.text_or(F.col(column), S.NULL_VALUE)


def with_values(df: DataFrame, columns: list[str], bins: int = 5) -> DataFrame:
    """df with each column replaced by its cross-tab values."""
    return df.withColumns({c: value_of(df, c, bins) for c in columns})


def crosstab(df: DataFrame, cluster: str, columns: list[str]) -> DataFrame:
    """Enrichment of every value of every column in every cluster, in one pass over long rows.

    One grouped count by (col, value, cluster) feeds the rest: sizes and overall counts are sums over it.
    Columns: col, cluster, value, count, cluster_size, cluster_share, overall_count, overall_share, enrichment.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("col"), S.text_or(F.col(c), S.NULL_VALUE).alias("value")) for c in columns))).alias("p")
    base = df.select(F.col(cluster).alias("cluster"), pairs).groupBy("cluster", F.col("p.col").alias("col"), F.col("p.value").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    sizes = base.groupBy("col", "cluster").agg(F.sum("count").alias("cluster_size"))
    overall = base.groupBy("col", "value").agg(F.sum("count").alias("overall_count"))
    rows = base.groupBy("col").agg(F.sum("count").alias("n"))
    return (
        base.join(sizes, ["col", "cluster"]).join(overall, ["col", "value"]).join(F.broadcast(rows), "col")
        .select("col", "cluster", "value", "count", "cluster_size", (F.col("count") / F.col("cluster_size")).alias("cluster_share"), "overall_count", (F.col("overall_count") / F.col("n")).alias("overall_share"),
                ((F.col("count") / F.col("cluster_size")) / (F.col("overall_count") / F.col("n"))).alias("enrichment"))
    )


def top_values(table: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent values of each column and cluster, ties by value."""
    return top_by(table, ["col", "cluster"], [F.desc("count"), F.asc("value")], n)


def column_stats(top: DataFrame, min_count: int = Config.min_group) -> DataFrame:
    """Over-represented values (enrichment above 1, at least min_count rows) of each column and cluster: max, mean and
    sum of their enrichment, 4 decimals."""
    e = F.when((F.col("enrichment") > 1) & (F.col("count") >= min_count), F.col("enrichment"))
    return top.groupBy("cluster", "col").agg(F.round(F.coalesce(F.max(e), F.lit(0.0)), 4).alias("max"), F.round(F.coalesce(F.avg(e), F.lit(0.0)), 4).alias("mean"), F.round(F.coalesce(F.sum(e), F.lit(0.0)), 4).alias("sum"))


def drivers(stats: DataFrame, importance: float = 2.0, n: int = 6, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Columns that pass the gate, by their highest enrichment, at most n for each cluster, with their rank."""
    return top_by(stats.where((F.col("sum") > importance) & ~F.col("col").isin(*excluded or ("",))), ["cluster"], [F.desc("max"), F.asc("col")], n)


def mode_values(df: DataFrame, cluster: str, columns: list[str]) -> DataFrame:
    """Most frequent value of each column in each cluster; ties go to the smaller value."""
    table = crosstab(df, cluster, columns)
    return top_by(table, ["col", "cluster"], [F.desc("count"), F.asc("value")], 1).select("cluster", "col", "value", "count")


def value_groups(df: DataFrame, cluster: str, way: str, columns: list[str], picked: DataFrame, config: Config) -> DataFrame:
    """Groups of rows with equal values in the driver columns of their cluster, the direction always first.

    path: the columns and values that pin the group, as 'col=value' in order of the drivers. Clusters without a
    driver are grouped by direction alone and keep their small groups. Ranks are by size, then cluster and path.
    """
    order = picked.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "col"))).alias("d")).select("cluster", F.col("d.col").alias("cols"))  # at most max_split names
    values = F.create_map(*(x for c in columns for x in (F.lit(c), S.text_or(F.col(c), S.NULL_VALUE))))
    path = F.transform(F.coalesce("cols", F.array().cast("array<string>")), lambda c: F.concat(c, F.lit("="), values[c]))
    return (
        df.join(F.broadcast(order), df[cluster] == order["cluster"], "left").select(df["*"], path.alias("path"))
        .groupBy(F.col(cluster).alias("cluster"), F.col(way).alias("direction"), "path").agg(F.count(F.lit(1)).alias("size"))
        .where((F.size("path") == 0) | (F.col("size") >= config.min_group))
    )


def capped(groups: DataFrame, n: int) -> DataFrame:
    """The n largest groups, numbered from 1; what is numbered is at most n rows."""
    order = [F.desc("size"), F.asc("cluster"), F.asc("direction"), F.asc("path_text")]
    top = groups.withColumn("path_text", F.array_join("path", " / ")).orderBy(*order).limit(n)
    return top.withColumn("group_no", F.row_number().over(Window.orderBy(*order)))


def assigned(df: DataFrame, cluster: str, way: str, columns: list[str], picked: DataFrame, groups: DataFrame) -> DataFrame:
    """df with the number of each row's group, null where its group was too small or beyond the cap."""
    order = picked.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "col"))).alias("d")).select(F.col("cluster").alias("__c"), F.col("d.col").alias("cols"))
    values = F.create_map(*(x for c in columns for x in (F.lit(c), S.text_or(F.col(c), S.NULL_VALUE))))
    path = F.array_join(F.transform(F.coalesce("cols", F.array().cast("array<string>")), lambda c: F.concat(c, F.lit("="), values[c])), " / ")
    named = groups.select(F.col("cluster").alias("__gc"), F.col("direction").alias("__gd"), F.col("path_text").alias("__gp"), "group_no")
    rows = df.join(F.broadcast(order), df[cluster] == order["__c"], "left").withColumn("__p", path).drop("__c", "cols")
    return rows.join(F.broadcast(named), (rows[cluster] == named["__gc"]) & (rows[way] == named["__gd"]) & (rows["__p"] == named["__gp"]), "left").drop("__gc", "__gd", "__gp", "__p")


def descriptions(rows: DataFrame, group: str, column: str, n: int = 20) -> DataFrame:
    """Counts of a column's values in each group: the n most frequent, and the rest under (other)."""
    base = rows.where(F.col(group).isNotNull()).groupBy(group, S.text_or(F.col(column), S.NULL_VALUE).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    ranked = base.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("count"), F.asc("value"))))
    named = F.when(F.col("rank") <= n, F.col("value")).otherwise("(other)")
    return ranked.groupBy(group, named.alias("value")).agg(F.sum("count").alias("count"))


def tree_nodes(groups: DataFrame) -> DataFrame:
    """Nodes of the tree of root causes: each prefix of a group's path under its cluster and direction, with the
    groups and rows below it. Depth 0 is the direction."""
    depth = F.explode(F.sequence(F.lit(0), F.size("path"))).alias("depth")
    nodes = groups.select("cluster", "direction", "path", "size", depth)
    node = F.array_join(F.slice("path", F.lit(1), F.col("depth")), " / ")
    return nodes.groupBy("cluster", "direction", "depth", node.alias("node")).agg(F.count(F.lit(1)).alias("groups"), F.sum("size").alias("rows"))


def truncated(groups: DataFrame, enrichment: DataFrame, importance: float) -> DataFrame:
    """Groups with their paths cut before the first value whose own enrichment is under the level (0 if unknown)."""
    rest = [c for c in groups.columns if c != "path"]
    steps = groups.select(*rest, "path", F.posexplode_outer("path").alias("pos", "step"))
    known = enrichment.select("cluster", F.concat("col", F.lit("="), "value").alias("step"), "enrichment")
    strong = steps.join(known, ["cluster", "step"], "left").withColumn("weak", F.coalesce("enrichment", F.lit(0.0)) < importance)
    cut = strong.groupBy(*rest, "path").agg(F.min(F.when(F.col("weak") & F.col("step").isNotNull(), F.col("pos"))).alias("at"))
    return cut.select(*rest, F.slice("path", F.lit(1), F.coalesce("at", F.size("path"))).alias("path"), F.col("path").alias("whole"))


def reasons(signatures: DataFrame, cluster: str = "cluster", n: int = Config.top_reasons) -> DataFrame:
    """The n source columns with the largest mean contribution, either way, to each cluster, with their rank."""
    return top_by(signatures, [cluster], [F.desc(F.abs("mean_shap")), F.asc("feature_group")], n)


def not_important(reasons: DataFrame, stats: DataFrame, importance: float = 2.0, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Reasons that are crossed but do not pass the gate of drivers: (cluster, col, rank, max, mean, sum)."""
    named = reasons.select("cluster", F.col("feature_group").alias("col"), "rank").where(~F.col("col").isin(*excluded or ("",)))
    return named.join(stats.where(F.col("sum") <= importance), ["cluster", "col"])


def described(rows: DataFrame, groups: DataFrame, describe: str, driver: str, n: int = 20) -> DataFrame:
    """Counts of a column's values in the rows under each node of the tree that ends in a driver column: (cluster,
    direction, node, value, count), the n most frequent and the rest under (other)."""
    at = F.expr(f"array_position(transform(path, s -> startswith(s, '{driver}=')), true)").cast("int")
    nodes = groups.withColumn("at", at).where("at > 0").select("group_no", F.struct("cluster", "direction", F.array_join(F.slice("path", F.lit(1), F.col("at")), " / ").alias("node")).alias("n"))
    named = rows.where("group_no IS NOT NULL").select("group_no", describe).join(F.broadcast(nodes), "group_no")  # at most max_groups nodes
    return descriptions(named, "n", describe, n).select("n.*", "value", "count")
