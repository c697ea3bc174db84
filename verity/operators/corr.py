"""Ratios by pair, correlations by group, encodings for them, and canonical correlations of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verity.functions import scalars as S
from verity.sources.folders import kept


def ratio_by(df: DataFrame, keys: list[str], flag: Column) -> DataFrame:
    """Share of rows with a flag (null rows do not count in it) and rows, by keys."""
    return df.groupBy(*keys).agg(F.avg(flag.cast("double")).alias("ratio"), F.count(F.lit(1)).alias("n_rows"))


def pivoted(ratios: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    return ratios.groupBy(row).pivot(column, values).agg(F.first("ratio"))


def combos(df: DataFrame, keys: list[str], min_rows: int = 0, limit: int | None = None) -> DataFrame:
    """Row counts of key combinations with at least min_rows, largest first."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= min_rows).orderBy(F.desc("n_rows"), *keys)
    return out.limit(limit) if limit else out


def dense_codes(df: DataFrame, column: str, name: str) -> DataFrame:
    """Dense rank of a column's values, null for null. Ranks are given to distinct values: each range partition
    numbers its own and adds the sizes of those before it (a number for each partition)."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column).sortWithinPartitions(column)
    # Kept as a table: ranges are sampled, so places must not be made again after their sizes were taken.
    numbered = kept(values.select(column, F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("i")))
    sizes = {r["p"]: r["count"] for r in numbered.groupBy("p").count().collect()}
    base, before = {}, 0
    for p in sorted(sizes):
        base[p], before = before, before + sizes[p]
    offset = F.create_map(*(F.lit(x) for kv in base.items() for x in kv))[F.col("p")] if base else F.lit(0)
    codes = numbered.select(F.col(column).alias("__v"), (F.col("i") + offset + 1).cast("long").alias(name))
    return df.join(codes, df[column] == codes["__v"], "left").drop("__v")


def numeric(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """Columns as doubles for correlation: booleans and numbers cast, times as microseconds, vectors dropped, other
    values by dense rank."""
    plain, ranked = {}, []
    for c in columns:
        t = df.schema[c].dataType
        if isinstance(t, T.ArrayType | T.BinaryType):
            continue
        if S.is_time(t):
            plain[c] = S.micros(F.col(c)).cast("double")
        elif S.is_number(t) or isinstance(t, T.BooleanType):
            plain[c] = F.col(c).cast("double")
        else:
            ranked.append(c)
    for c in ranked:
        df = dense_codes(df, c, f"__{c}").withColumn(c, F.col(f"__{c}").cast("double")).drop(f"__{c}")
    return df.withColumns(plain).select(*keep, *(c for c in columns if c in plain or c in ranked))


def since_first(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """A time column as milliseconds since its first value in the group: a grouped minimum joined back."""
    low = df.groupBy(*by).agg(F.min(S.micros(F.col(column))).alias("__m"))
    return df.join(F.broadcast(low) if not by else low, by).withColumn(column, (S.micros(F.col(column)) - F.col("__m")) / 1000.0).drop("__m")


def finite_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose values in all columns are there and finite."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    return df.where(ok)


#: A column counts as constant if its variance is below this share of its mean square (around the overall mean).
CONSTANT = 1e-14


def sums_by(df: DataFrame, columns: list[str], by: list[str], step, complete: bool = False) -> DataFrame:
    """(by..., x): the sum over a group's rows of step(values, present) -> flat array, added up in numpy in each task,
    so that the shuffle is tasks times the array's length. Values are shifted by the columns' means over all rows
    (large offsets would eat the digits of products), missing ones are 0 and not present."""
    keys = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by)
    cells = [f"__{k}" for k in range(len(columns))]
    slim = df.select(*by, *(F.col(c).cast("double").alias(n) for c, n in zip(columns, cells, strict=True)))
    means = finite(df, columns).agg(*(F.avg(c).alias(c) for c in columns)).first()
    shift = np.array([means[c] if means[c] is not None else 0.0 for c in columns])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[tuple, np.ndarray] = {}
        for f in frames:
            for key, part in f.groupby(list(by), dropna=False, sort=False) if by else [((), f)]:
                x = part[cells].to_numpy(np.float64) - shift
                here = np.isfinite(x)
                if complete:
                    x, here = x[here.all(1)], here[here.all(1)]
                if len(x):
                    new = step(np.where(here, x, 0.0), here.astype(np.float64))
                    key = tuple(None if k is pd.NaT or (isinstance(k, float) and np.isnan(k)) else k for k in key)
                    acc[key] = acc[key] + new if key in acc else new
        if acc:
            yield pd.DataFrame([[*key, x.tolist()] for key, x in acc.items()], columns=[*by, "x"])

    parts = slim.mapInPandas(run, f"{keys + ', ' if keys else ''}x array<double>")
    long = parts.select(*by, F.posexplode("x").alias("i", "x")).groupBy(*by, "i").agg(F.sum("x").alias("x"))
    return long.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("x"))


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as doubles, null where they are not finite."""
    each = {c: F.col(c).cast("double") for c in columns}
    return df.select(*(F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x).alias(c) for c, x in each.items()))


def pearson(a: Column, b: Column) -> Column:
    """Correlation over rows where both are there; null where one is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


#: Most columns whose correlations are plain aggregates.
PLAIN_COLUMNS = 8


def correlations(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """Upper triangle in long form: by..., i, j, r, over the rows where both columns are there and finite; null where
    one is constant. A few columns are plain aggregates; for more, whose pairs would make too large an aggregate, four
    matrix products for a batch of rows."""
    by, d = list(by), len(columns)
    if d <= PLAIN_COLUMNS:
        pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
        wide = df.withColumns({c: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x) for c in columns for x in [F.col(c).cast("double")]})
        wide = wide.groupBy(*by).agg(*(pearson(F.col(a), F.col(b)).alias(f"__{k}") for k, (a, b) in enumerate(pairs)))
        cells = F.explode(F.array(*(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"__{k}").alias("r")) for k, (a, b) in enumerate(pairs)))).alias("c")
        return wide.select(*by, cells).select(*by, "c.i", "c.j", "c.r")
    step = lambda x, here: np.stack([here.T @ here, x.T @ here, (x * x).T @ here, x.T @ x]).ravel()
    i, j = np.triu_indices(d, 1)
    first, second = np.array(columns, object)[i], np.array(columns, object)[j]
    keys = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                n, s, q, p = np.asarray(row["x"]).reshape(4, d, d)
                with np.errstate(divide="ignore", invalid="ignore"):
                    var = q - s * s / n  # of the first column over the rows that have both
                    live = (n > 1) & (var > CONSTANT * q) & (var.T > CONSTANT * q.T)
                    r = np.where(live, (p - s * s.T / n) / np.sqrt(var * var.T), np.nan)[i, j]
                out = pd.DataFrame({"i": first, "j": second, "r": [None if np.isnan(v) else v for v in r]})
                for k in by[::-1]:
                    out.insert(0, k, [row[k]] * len(out))
                yield out

    return sums_by(df, columns, by, step).mapInPandas(run, f"{keys + ', ' if keys else ''}i string, j string, r double")


# --- canonical correlation of blocks -------------------------------------------------------------------------


def block_order(blocks: dict[str, list[str]], tabular: list[str], text: list[str]) -> list[str]:
    first = [b for b in tabular if b in blocks] + [b for b in text if b in blocks]
    return first + sorted(b for b in blocks if b not in first)


#: A column varies if its standard deviation is above both; distinct rows are told apart at this share
#: of the largest value.
LEAST_STD, LEAST_SHARE, ROUNDING = 1e-12, 1e-7, 1e-6


def varies(std: float, scale: float) -> bool:
    return std > LEAST_STD and std > LEAST_SHARE * scale


def moments(df: DataFrame, columns: list[str], by: list[str], needed: int) -> DataFrame:
    """(by..., x, scale, distinct) of complete rows by group: count, sums and products of shifted values, each column's
    largest value, and how many different rows there are after rounding, counted exactly up to `needed`."""
    step = lambda x, here: np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
    complete = finite_rows(df, columns)
    sums = sums_by(complete, columns, by, step, complete=True)
    scale = complete.groupBy(*by).agg(F.array(*(F.max(F.abs(F.col(c).cast("double"))) for c in columns)).alias("scale"))
    unit = F.greatest(F.array_max("scale") * ROUNDING, F.lit(1e-300))
    same = (lambda a, b: a.join(b, by)) if by else (lambda a, b: a.crossJoin(b))
    rounded = same(complete.select(*by, *columns), scale).select(*by, F.xxhash64(*(F.round(F.col(c).cast("double") / unit) for c in columns)).alias("h"))
    keys = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by)

    def some(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """At most `needed` different rows of a group leave a task."""
        seen: dict[tuple, set] = {}
        for f in frames:
            for key, part in f.groupby(list(by), dropna=False, sort=False) if by else [((), f)]:
                own = seen.setdefault(tuple(key), set())
                if len(own) < needed:
                    own.update(part["h"].unique()[: needed + len(own)].tolist())
        out = [[*key, h] for key, own in seen.items() for h in sorted(own)[:needed]]
        if out:
            yield pd.DataFrame(out, columns=[*by, "h"])

    different = rounded.mapInPandas(some, f"{keys + ', ' if keys else ''}h long").groupBy(*by).agg(F.least(F.count_distinct("h"), F.lit(needed)).alias("distinct"))
    return same(same(sums, scale), different)


def first_canonical(cov: np.ndarray, x: list[int], y: list[int]) -> float:
    """Largest canonical correlation of two blocks from their joint covariance."""

    def root(idx: list[int]) -> np.ndarray:
        w, v = np.linalg.eigh(cov[np.ix_(idx, idx)])
        ok = w > max(w.max(), 0) * 1e-10
        return v[:, ok] / np.sqrt(w[ok])

    a, b = root(x), root(y)
    if not a.shape[1] or not b.shape[1]:
        return float("nan")
    return float(np.clip(np.linalg.svd(a.T @ cov[np.ix_(x, y)] @ b, compute_uv=False)[0], 0.0, 1.0))


def block_correlations(df: DataFrame, blocks: dict[str, list[str]], by: list[str], target: str | None = None) -> DataFrame:
    """First canonical correlation of every pair of blocks in every group, in long form: by..., i, j, r.

    r is null if a block has no varying column or the group has too few distinct rows for the blocks' widths
    (max(widths + 1, 3)); against a one-column target it carries the sign of the strongest plain correlation.
    """
    names = list(blocks)
    columns = [c for b in names for c in blocks[b]]
    place = {c: k for k, c in enumerate(columns)}
    width = len(columns)
    keys = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                x = np.asarray(row["x"])
                n, mean = max(1.0, x[0]), x[1 : 1 + width] / max(1.0, x[0])
                cov = x[1 + width :].reshape(width, width) / n - np.outer(mean, mean)
                std = np.sqrt(np.maximum(np.diag(cov), 0))
                live = [varies(s, m) for s, m in zip(std, row["scale"], strict=True)]
                out = []
                for a, i in enumerate(names):
                    for j in names[a + 1 :]:
                        x, y = ([place[c] for c in blocks[b] if live[place[c]]] for b in (i, j))
                        r = float("nan")
                        if x and y and row["distinct"] >= max(len(x) + len(y) + 1, 3):
                            scale = np.where(std > 0, std, 1.0)
                            corr = cov / np.outer(scale, scale)
                            r = first_canonical(corr, x, y)
                            if target in (i, j):
                                block = corr[np.ix_(x, y)].ravel()
                                r = float(np.copysign(r, block[np.abs(block).argmax()]))
                        out.append([*(row[k] for k in by), i, j, None if np.isnan(r) else r])
                yield pd.DataFrame(out, columns=[*by, "i", "j", "r"])

    needed = max([3, *(len(blocks[i]) + len(blocks[j]) + 1 for a, i in enumerate(names) for j in names[a + 1 :])])
    return moments(df, columns, list(by), needed).mapInPandas(run, f"{keys + ', ' if keys else ''}i string, j string, r double")
