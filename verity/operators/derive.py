"""Derived columns, splits and samples by group, the text dictionary."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verity.functions import scalars as S


def group_rows(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows of each row's group (a null key is a group): a grouped count joined back, so a hot group is no one task's."""
    counts = df.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias(name))
    return df.join(counts, df[key].eqNullSafe(counts["__k"]), "left").drop("__k")


def derived(df: DataFrame, flag: str, flags: dict[str, str], group: str, json_text: str, rows_name: str, items_name: str) -> DataFrame:
    """Add those of the derived columns that df lacks: equality flags, rows of the group, quoted items."""
    have = set(df.columns)
    df = df.withColumns({n: F.col(flag) == v for n, v in flags.items() if n not in have and flag in have} | ({items_name: S.quoted_items(F.col(json_text))} if items_name not in have and json_text in have else {}))
    return group_rows(df, group, rows_name) if rows_name not in have and group in have else df


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).where(F.col(key).isNotNull()).distinct()


def subsample_groups(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n distinct keys in the seeded order."""
    return distinct_keys(df, key).orderBy(S.seeded(seed, F.col(key)), key).limit(n)


def split_groups(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """(key, is_test): exactly ceil(share * n) test keys, the first in the seeded order.

    The keys are not ranked in one window: the hash at the boundary is found, and the rest is a comparison.
    """
    keys = distinct_keys(df, key).withColumn("__h", S.seeded(seed, F.col(key)))
    n = keys.count()
    k = math.ceil(round(test_share * n, 9))
    if not k:
        return keys.select(key, F.lit(False).alias("is_test"))
    last = _kth(keys, k)
    return keys.select(key, (F.col("__h") <= F.lit(last)).alias("is_test"))


def _kth(keys: DataFrame, k: int) -> str:
    """The k-th smallest hash: counts by leading hex digits narrow it down, so no task sorts all keys."""
    prefix = ""
    while True:
        here = keys.where(F.col("__h").startswith(prefix)) if prefix else keys
        width = len(prefix) + 4
        counts = here.groupBy(F.substring("__h", 1, width).alias("p")).count().orderBy("p").collect()  # at most 65,536
        for r in counts:
            if k <= r["count"]:
                prefix = r["p"]
                if r["count"] <= 10_000 or width >= 32:
                    return keys.where(F.col("__h").startswith(prefix)).select("__h").orderBy("__h").limit(k).agg(F.max("__h")).first()[0]
                break
            k -= r["count"]


def rows_of_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement in the seeded order of a unique key."""
    return df.orderBy(S.seeded(seed, F.col(key)), key).limit(n)


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """DISTINCT ON: of each key the first row by an explicit order; a partial aggregate, no sort of a group."""
    rest = [c for c in df.columns if c not in keys]
    low = F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")
    return df.groupBy(*keys).agg(low).select(*keys, *(F.col("__r")[c].alias(c) for c in rest))


def dictionary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, text, n): distinct texts of each column with their frequency; null counts as MISSING."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("col"), S.text_or(F.col(c)).alias("text")) for c in columns))).alias("p")
    return df.select(pairs).groupBy(F.col("p.col").alias("col"), F.col("p.text").alias("text")).agg(F.count(F.lit(1)).alias("n"))


def gather(df: DataFrame, table: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Look up each row's text of one column in a dictionary (col, text, ...)."""
    own = table.where(F.col("col") == column).select(F.col("text").alias("__t"), *values)
    return df.join(own, S.text_or(F.col(column)) == F.col("__t"), "left").drop("__t")


def uncovered(df: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """Texts that the dictionary lacks: what is still to be encoded; empty if it covers the table."""
    return dictionary(df, columns).join(table.select("col", "text"), ["col", "text"], "left_anti")


def top_by(df: DataFrame, group: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """First n rows of each group by an order that has no ties."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)
