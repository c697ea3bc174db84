"""Scalar expressions of the audit, all JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING, NULL_VALUE = "MISSING", "<null>"
#: Names of the four directions of an error.
LABEL_MISSING, NOT_CAPTURED, UNEXPECTED, AGREES = "label_missing", "own_not_captured", "unexpected_own_flag", "no_disagreement"


def text_or(column: Column, literal: str = MISSING) -> Column:
    """Text of a value, with a literal for null."""
    return F.coalesce(column.cast("string"), F.lit(literal))


def quoted_items(column: Column) -> Column:
    """Items of a JSON array kept as text: pairs of double quotes; null has none."""
    return F.coalesce(F.floor(F.regexp_count(column, F.lit('"')) / 2), F.lit(0)).cast("int")


def is_error(truth: Column, predicted: Column) -> Column:
    """A row is in error if its truth is missing or differs from the prediction."""
    return F.when(truth.isNull(), F.lit(True)).otherwise(predicted != truth)


def direction(truth: Column, predicted: Column) -> Column:
    return (
        F.when(truth.isNull(), LABEL_MISSING).when(predicted & ~truth, NOT_CAPTURED).when(~predicted & truth, UNEXPECTED).otherwise(AGREES)
    )


def flagged(probability: Column, threshold: float | None = None) -> Column:
    """1 at or above the threshold; without one above one half, as an arg-max would say."""
    return (probability >= F.lit(threshold) if threshold is not None else probability > F.lit(0.5)).cast("int")


def as_mask(column: Column) -> Column:
    return F.coalesce(column, F.lit(False))


def micros(column: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone, or a date (session zone UTC)."""
    return F.unix_micros(column.cast("timestamp"))


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_time(kind: T.DataType) -> bool:
    return isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType)


def tabular(df: DataFrame, columns: list[str], kind: str = "float") -> DataFrame:
    """Cast booleans, numbers and times among `columns` to one float type; leave others alone."""
    new = {}
    for c in columns:
        t = df.schema[c].dataType
        if is_time(t):
            new[c] = micros(F.col(c)).cast(kind)
        elif is_number(t) or isinstance(t, T.BooleanType):
            new[c] = F.col(c).cast(kind)
    return df.withColumns(new)


def file_safe(column: Column) -> Column:
    return F.regexp_replace(column, r"[^\p{L}\p{N}_.-]", "_")


def base_column(column: Column) -> Column:
    """Source column of a feature name: what comes before _EMB_PC<n> or _EMB_DIM<nnn>, else the name itself."""
    found = F.regexp_extract(column, r"^(.+?)_EMB_(?:PC\d+|DIM\d{3})$", 1)
    return F.when(found != "", found).otherwise(column)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalised(vector: Column, floor: float = 1e-12) -> Column:
    norm = F.greatest(F.sqrt(dot(vector, vector)), F.lit(floor))
    return F.transform(vector, lambda x: x.cast("double") / norm)


def projected(vector: Column, axes: list[list[float]], mean: list[float]) -> Column:
    """(vector - mean) times each axis, with axes and mean as literals (a few numbers each)."""
    centre = F.array(*(F.lit(float(m)) for m in mean))
    moved = F.zip_with(vector, centre, lambda x, m: x.cast("double") - m)
    return F.array(*(dot(moved, F.array(*(F.lit(float(a)) for a in axis))) for axis in axes))


def spread(df: DataFrame, array: str, names: list[str]) -> DataFrame:
    """An array column as named scalar columns."""
    return df.select(*(c for c in df.columns if c != array), *(F.col(array)[i].alias(n) for i, n in enumerate(names)))


def json_of(keys_and_values: dict[str, Column]) -> Column:
    """JSON text with sorted keys."""
    return F.to_json(F.struct(*(keys_and_values[k].alias(k) for k in sorted(keys_and_values))))


def seeded(seed: int, key: Column) -> Column:
    """A deterministic order of keys: the md5 of the seed and the key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
