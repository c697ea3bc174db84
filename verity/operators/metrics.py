"""Classification metrics as single aggregates, exact under ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verity.sources.folders import kept


def share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def counts(df: DataFrame, truth: str, predicted: str, *by: str) -> DataFrame:
    """tp, fp, fn, tn over rows with a truth."""
    t, p = F.col(truth), F.col(predicted)
    return df.where(t.isNotNull()).groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))


def binary(df: DataFrame, truth: str, predicted: str, *by: str) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts(df, truth, predicted, *by).select(
        *by, share(tp + tn, tp + tn + fp + fn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1")
    )


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.where(F.col(truth).isNotNull()).groupBy(F.col(truth).cast("int").alias("truth"), F.col(predicted).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of both classes, and their macro and weighted means."""
    c = counts(df, truth, predicted)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    row = lambda name, hit, over, under: F.struct(F.lit(name).alias("class"), share(hit, hit + over).alias("precision"), share(hit, hit + under).alias("recall"), share(2 * hit, 2 * hit + over + under).alias("f1"), (hit + under).alias("support"))
    each = c.select(F.explode(F.array(row("0", tn, fn, fp), row("1", tp, fp, fn))).alias("r")).select("r.*")
    means = ("precision", "recall", "f1")
    macro = each.agg(*(F.avg(m).alias(m) for m in means), F.sum("support").alias("support")).select(F.lit("macro").alias("class"), *means, "support")
    weighted = each.agg(*(share(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in means), F.sum("support").alias("s")).select(F.lit("weighted").alias("class"), *means, F.col("s").alias("support"))
    return each.unionByName(macro).unionByName(weighted)


def by_score(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(score, pos, neg): one row for each distinct score, counted once and kept for the passes that follow."""
    return kept(_by_score(df, truth, score))


def _by_score(df: DataFrame, truth: str, score: str) -> DataFrame:
    return df.where(F.col(truth).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(truth)).alias("pos"), F.count_if(~F.col(truth)).alias("neg"))


def cumulated(per: DataFrame, key: str, columns: list[str], descending: bool, buckets: int = 256) -> DataFrame:
    """Running sums along a key, in parallel: buckets of the key's quantiles, their totals, and sums inside each.

    The only ordered window over everything has one row for each bucket.
    """
    cuts = per.agg(F.percentile_approx(key, [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    dealt = per.withColumn("__b", bucket_of(F.col(key), sorted(set(cuts))))
    order = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    totals = dealt.groupBy("__b").agg(*(F.sum(c).alias(f"__{c}") for c in columns))
    before = Window.orderBy(order("__b")).rowsBetween(Window.unboundedPreceding, -1)  # at most `buckets` rows
    totals = totals.select("__b", *(F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in columns))
    inside = Window.partitionBy("__b").orderBy(order(key)).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(F.broadcast(totals), "__b").select(*per.columns, *((F.sum(c).over(inside) + F.col(f"__{c}")).alias(f"cum_{c}") for c in columns))


def bucket_of(value: Column, cuts: list, first: int = 0) -> Column:
    """How many of the ascending cuts a value is not below, by halving: a row is compared with the log of their number."""
    if not cuts:
        return F.lit(first)
    half = len(cuts) // 2
    return F.when(value >= F.lit(cuts[half]), bucket_of(value, cuts[half + 1 :], first + half + 1)).otherwise(bucket_of(value, cuts[:half], first))


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Exact area: of all pairs of classes the share in order, ties by half; null with a single class."""
    run = cumulated(by_score(df, truth, score), "score", ["neg"], descending=False)
    won = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2))
    return run.agg(F.try_divide(won.cast("double"), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def precision_recall(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(threshold, precision, recall) for each distinct score: flagged are rows at or above it."""
    per = by_score(df, truth, score)
    run = cumulated(per, "score", ["pos", "neg"], descending=True)
    total = per.agg(F.sum("pos").alias("total"))
    return run.crossJoin(F.broadcast(total)).select(F.col("score").alias("threshold"), share(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"), share(F.col("cum_pos"), F.col("total")).alias("recall"))


def threshold_for_recall(df: DataFrame, truth: str, score: str, floor: float) -> DataFrame:
    """The highest threshold whose recall is at least the floor, with what it gives; no row without positives."""
    ok = precision_recall(df, truth, score).where((F.col("recall") >= floor) & (F.col("recall") > 0))
    return ok.groupBy().agg(F.max(F.struct("threshold", "precision", "recall")).alias("b")).where("b IS NOT NULL").select("b.*")


def class_weight(df: DataFrame, truth: str) -> DataFrame:
    """Negatives over positives, both at least one."""
    pos, neg = F.count_if(F.col(truth)), F.count_if(~F.col(truth))
    return df.agg(pos.alias("pos"), neg.alias("neg")).select("pos", "neg", (F.greatest("neg", F.lit(1)) / F.greatest("pos", F.lit(1))).alias("weight"))
