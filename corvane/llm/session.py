"""Session helpers: where shared files go and how lineage is cut."""

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table, pruned to the named columns."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("*",)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir.

    Only on one machine, where that setting is absent (tests), is a folder of our own made.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = os.environ.get("CORVANE_SHARED_DIR") or os.path.join(tempfile.gettempdir(), "corvane-shared")
    return f"file://{own}"


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/corvane-{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again.

    The files outlive executors, so a lost one costs a re-read and no recomputation.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Beyond this many, partitions grow instead: a driver keeps a status for each pair of map and reduce task.
MAX_PARTS = 50_000


def scaled(total: int, per_part: int, least: int = 12) -> int:
    """Number of partitions that keeps each at about per_part units, up to MAX_PARTS of them."""
    return min(MAX_PARTS, max(least, -(-int(total) // per_part)))


MAX_RANGES = 4_096


def range_of(df: DataFrame, column: str, rows_each: int) -> Column:
    """The number, from 0, of a whole-numbered column's range: ranges hold about rows_each rows (more beyond MAX_RANGES of them), whatever values are like.

    Bounds are approximate quantiles, at most MAX_RANGES numbers, and are searched by halves. Null gives -1.
    """
    n = min(MAX_RANGES, scaled(df.agg(F.count(column)).first()[0], rows_each, 1))
    found = df.agg(F.percentile_approx(column, [k / n for k in range(1, n)], 4 * n)).first()[0] if n > 1 else None
    bounds = sorted({int(x) for x in found or [] if x >= -(2**63)})
    if not bounds:
        return F.when(F.col(column).isNull(), -1).otherwise(0)
    held = f"array({', '.join(f"bigint('{x}')" for x in bounds)})"
    middle = "cast((s.low + s.high) div 2 as int)"
    step = f"if(s.low >= s.high, s, if({held}[{middle}] < {column}, struct({middle} + 1 as low, s.high as high), struct(s.low as low, {middle} as high)))"
    # the number of bounds below the value
    below = F.expr(f"aggregate(sequence(1, {len(bounds).bit_length()}), struct(0 as low, {len(bounds)} as high), (s, _) -> {step}, s -> s.low)")
    return F.when(F.col(column).isNull(), -1).otherwise(below)
