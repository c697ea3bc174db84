"""Timers with estimates, run reports and log schemas."""

from __future__ import annotations

import contextlib
import dataclasses
import json
import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_fields = lambda names, kind: [T.StructField(n, kind) for n in names.split()]
TRAINING_LOG = T.StructType(_fields("run_id created_at strategy mode backend", T.StringType()) + _fields("n_rows n_groups n_features total_k", T.LongType()) + _fields("mean_k mean_variance min_variance max_variance accuracy precision recall f1 auc seconds", T.DoubleType()) + _fields("per_column_json model_path", T.StringType()))
QA_LOG = T.StructType(_fields("run_id created_at source strategy", T.StringType()) + _fields("n_rows n_labelled n_errors n_flagged", T.LongType()) + _fields("accuracy precision recall f1 auc seconds", T.DoubleType()) + _fields("scored_path", T.StringType()))
COLUMN_LOG = T.StructType(_fields("run_id strategy column", T.StringType()) + _fields("k", T.LongType()) + _fields("variance", T.DoubleType()) + _fields("ratios_json", T.StringType()))


def run_id() -> str:
    return datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")


@dataclasses.dataclass
class Timer:
    """Seconds by step; estimates blend what was seen with what was expected, half and half."""

    expected: dict[str, float] = dataclasses.field(default_factory=dict)
    spark: SparkSession | None = None
    done: list[tuple[str, float]] = dataclasses.field(default_factory=list)

    @contextlib.contextmanager
    def step(self, name: str):
        if self.spark is not None:
            self.spark.sparkContext.setJobDescription(name)
        began = time.monotonic()
        try:
            yield
        finally:
            seconds = time.monotonic() - began
            self.done.append((name, seconds))
            self.expected[name] = 0.5 * seconds + 0.5 * self.expected.get(name, seconds)
            if self.spark is not None:
                self.spark.sparkContext.setJobDescription(None)

    def remaining(self, ahead: list[str]) -> float:
        return sum(self.expected.get(n, 0.0) for n in ahead)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.done, "step string, seconds double")


def rolled_up(steps: DataFrame, step: str = "step", seconds: str = "seconds") -> DataFrame:
    return steps.groupBy(step).agg(F.sum(seconds).alias("seconds"))


def reduction_summary(per_column: DataFrame) -> DataFrame:
    """(mean_k, max_k, total_k, mean/min/max variance) of per-column rows (column, k, variance)."""
    return per_column.agg(F.avg("k").alias("mean_k"), F.max("k").alias("max_k"), F.sum("k").alias("total_k"), F.avg("variance").alias("mean_variance"), F.min("variance").alias("min_variance"), F.max("variance").alias("max_variance"))


@dataclasses.dataclass
class RunReport:
    """Sections of a run as JSON and Markdown."""

    title: str
    sections: dict[str, dict] = dataclasses.field(default_factory=dict)

    def add(self, section: str, **values) -> None:
        self.sections.setdefault(section, {}).update(values)

    def json(self) -> str:
        return json.dumps({"title": self.title, **self.sections}, sort_keys=True, default=str)

    def markdown(self) -> str:
        out = [f"# {self.title}"]
        for name, values in self.sections.items():
            out += ["", f"## {name}", "", "| key | value |", "|---|---|", *(f"| {k} | {v} |" for k, v in values.items())]
        return "\n".join(out) + "\n"
