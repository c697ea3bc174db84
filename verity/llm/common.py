"""What the operators of this subpackage share: table reading, Arrow mapping in bounded pieces, folders.

Every operator takes a DataFrame and the names of its columns, selects only those, and so is indifferent to
extra columns with clashing names.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles at a time (a longer text is one piece).
PIECE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; if its scan has fewer splits than there are cores, rows are dealt out, so that a file of one row group
    does not leave all but one of them idle."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def quoted(df: DataFrame, name: str):
    """A column by its whole name, dots and blanks included."""
    return df["`" + name.replace("`", "``") + "`"]


def crc_mod(column: str, modulus: int):
    """crc32 of an id as text, modulo; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir; a local one is made only where the setting is absent."""
    return f"{checkpoint_root(spark).rstrip('/')}/verity-{uuid.uuid4().hex}"


def checkpoint_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder under a local master, else an error."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.verity.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="verity-checkpoint-")
        atexit.register(shutil.rmtree, root, True)
        spark.conf.set("spark.verity.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared checkpoint folder: lineage ends here and survives lost executors."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch whose texts add up to about `limit` bytes; every row is in one slice."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths, dtype=np.int64) // limit
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(a, b - a)


def map_pieces(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema, column: str = "text") -> DataFrame:
    """mapInArrow over pieces; make() builds the step once per task."""

    def run(batches):
        step = make()
        for batch in batches:
            for piece in pieces(batch, column):
                yield step(piece)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 texts of a batch; null counts as empty."""
    col = batch.column(column)
    return [b"" if x is None else x for x in col.cast(pa.binary()).to_pylist()]


def crc_mod_py(ident, modulus: int) -> int | None:
    return None if ident is None else zlib.crc32(str(ident).encode()) % modulus


def total_bytes(df: DataFrame, column: str) -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column: one scan that sends two numbers."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(column)).alias("b")).first()
    return row["n"], row["b"] or 0
