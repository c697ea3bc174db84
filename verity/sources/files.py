"""Scans, checks of files and sinks. Paths go through the session's Hadoop file systems, never open()."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def modified(spark: SparkSession, path: str) -> int:
    """Milliseconds of the last change of a file, or of the newest part of a folder; -1 if absent."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return -1
    status = fs.getFileStatus(p)
    times = [status.getModificationTime()] + ([s.getModificationTime() for s in fs.listStatus(p)] if status.isDirectory() else [])
    return max(times)


def readable(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet path has a schema: footers only."""
    try:
        return exists(spark, path) and bool(spark.read.parquet(path).schema)
    except Exception:
        return False


def schema_of(spark: SparkSession, path: str) -> T.StructType:
    return spark.read.parquet(path).schema


def row_count(spark: SparkSession, path: str) -> int:
    """Rows by the footers of a table's files; no row group is read."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    found = [fs.getFileStatus(p)] if fs.getFileStatus(p).isFile() else fs.listStatus(p)
    for status in found:
        if status.getPath().getName().startswith(("_", ".")) or not status.getLen():
            continue
        if status.isDirectory():
            n += row_count(spark, status.getPath().toString())
            continue
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromStatus(status, conf))
        n += reader.getRecordCount()
        reader.close()
    return n


def read_csv(spark: SparkSession, path: str, schema: T.StructType, times: dict[str, str] | None = None) -> DataFrame:
    """CSV with a header and declared types; `times` names columns read as text and parsed with a pattern."""
    times = times or {}
    raw = T.StructType([T.StructField(f.name, T.StringType() if f.name in times else f.dataType) for f in schema])
    df = spark.read.schema(raw).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.withColumns({c: F.to_timestamp_ntz(F.col(c), F.lit(p)) for c, p in times.items()})


def ingest(spark: SparkSession, csv: str, parquet: str, schema: T.StructType, times: dict[str, str] | None = None, force: bool = False) -> bool:
    """CSV to Parquet unless the Parquet is readable and at least as new; whether it was written."""
    if not force and readable(spark, parquet) and modified(spark, parquet) >= modified(spark, csv):
        return False
    write_atomic(read_csv(spark, csv, schema, times), parquet)
    return True


def write_atomic(df: DataFrame, path: str) -> None:
    """Write beside the target and move it there. The old table is moved aside first and deleted only when the new one
    is in place; if that fails it is moved back. A reader may find no table for the moment between the two moves."""
    spark = df.sparkSession
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(staging)
    fs, target = _path(spark, path)
    new = spark._jvm.org.apache.hadoop.fs.Path(staging)
    if not fs.exists(target):
        fs.mkdirs(target.getParent())
        if not fs.rename(new, target):
            raise OSError(f"could not move {staging} to {path}")
        return
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.old-{uuid.uuid4().hex}")
    if not fs.rename(target, old):
        fs.delete(new, True)
        raise OSError(f"could not move {path} aside")
    if not fs.rename(new, target):
        back = fs.rename(old, target)
        fs.delete(new, True)
        raise OSError(f"could not move {staging} to {path}; the old table is {'back' if back else f'in {old}'}")
    fs.delete(old, True)


def glob(spark: SparkSession, pattern: str) -> DataFrame:
    """All Parquet tables that match, by name, with the stem of each row's table as column `stem`; none: an error."""
    fs, p = _path(spark, pattern)
    found = sorted(s.getPath().toString() for s in fs.globStatus(p) or [])
    if not found:
        raise FileNotFoundError(pattern)
    last = len(found[0].rstrip("/").split("/")) - 1
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1) if found[0].endswith(".parquet") and not _is_dir(spark, found[0]) else F.split(F.col("_metadata.file_path"), "/")[F.lit(last)]
    df = spark.read.parquet(*found)
    return df.select("*", F.regexp_replace(name, r"(\.scored)?\.parquet$", "").alias("stem"))


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def latest(spark: SparkSession, pattern: str) -> str:
    """Of the paths that match the one changed last (ties: the last by name), for the newest run or cache; none: an error."""
    fs, p = _path(spark, pattern)
    found = [s.getPath().toString() for s in fs.globStatus(p) or []]
    if not found:
        raise FileNotFoundError(pattern)
    return max(found, key=lambda f: (modified(spark, f), f))


def _is_dir(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.getFileStatus(p).isDirectory()


def namespaced(df: DataFrame, stem: str, key: str, name: str = "group_key") -> DataFrame:
    """Keys of several files made distinct: stem::key."""
    return df.withColumn(name, F.concat(F.col(stem), F.lit("::"), F.col(key).cast("string")))


def derived_paths(csv: str, scored_root: str, embed_root: str, training_embed_root: str) -> dict[str, str]:
    """Where the tables of a CSV lie; the folder of training vectors is never among them."""
    stem = csv.rstrip("/").rsplit("/", 1)[-1].removesuffix(".csv")
    out = {"stem": stem, "parquet": csv.removesuffix(".csv") + ".parquet", "embeddings": f"{embed_root}/{stem}", "scored": f"{scored_root}/{stem}.scored.parquet"}
    if out["embeddings"].startswith(training_embed_root.rstrip("/") + "/") or out["embeddings"] == training_embed_root:
        raise ValueError("vectors of a scored table must not go to the training folder")
    return out


def cache_key(spark: SparkSession, inputs: list[str], **settings) -> str:
    """SHA-256 of the inputs' paths and times and of the settings."""
    state = {"inputs": [[p, modified(spark, p)] for p in sorted(inputs)], **{k: settings[k] for k in sorted(settings)}}
    return hashlib.sha256(json.dumps(state, sort_keys=True, default=str).encode()).hexdigest()


def cached(spark: SparkSession, root: str, key: str, make) -> DataFrame:
    """The table under root/key, made and written if it is not there."""
    path = f"{root}/{key}"
    if not readable(spark, path):
        write_atomic(make(), path)
    return spark.read.parquet(path)


def append_log(spark: SparkSession, row: dict, schema: T.StructType, path: str) -> list[str]:
    """Append one row to a log table of fixed columns; returns the keys that the log does not have."""
    values = tuple(row.get(f.name) for f in schema)
    spark.createDataFrame([values], schema).coalesce(1).write.mode("append").option("header", True).csv(path)
    return sorted(set(row) - set(schema.names))


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file of a small report."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(spark: SparkSession, value: object, path: str) -> None:
    text = json.dumps(value, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str):
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def batches(df: DataFrame, step, schema: str, beside: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """A step over Arrow batches as pandas frames, in bounded memory; with a second table, over rows joined by key."""
    both = df if beside is None else df.join(beside, key)
    return both.mapInPandas(lambda frames: (step(f) for f in frames), schema)
