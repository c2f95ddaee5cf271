"""Written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Where it is unset, a temporary
    folder of a local run; on a cluster that is an error, since executors wouldn't see each other's files."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="folioflow-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a new table in the application's part of the shared folder, which goes when the application ends."""
    root = f"{shared_dir(spark)}/folioflow/{spark.sparkContext.applicationId}"
    fs, path = _file(spark, root)
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return f"{root}/{uuid.uuid4().hex}-{name}"


def _file(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that came from `written` and that nothing reads any more."""
    fs, path = _file(df.sparkSession, df._written_to)
    fs.delete(path, True)


def slices(batches: Iterator[pd.DataFrame], rows: int = 256) -> Iterator[pd.DataFrame]:
    """A few rows at a time, so that what is made of long texts stays small."""
    for b in batches:
        for i in range(0, max(1, len(b)), rows):
            yield b.iloc[i : i + rows]


def numbered(df: DataFrame, order: tuple[str, ...], name: str = "position") -> DataFrame:
    """``df`` with its rows' places, from 1, in the order of columns. Rows are dealt by ranges of that order and written with
    their range; a range's rows are numbered alone and moved by the sizes of the ranges before it. So no task sees all
    rows, and what is broadcast is one number a range. ``df`` is written first, since finding the ranges reads it too."""
    ranges = written(written(df, "rows").repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).select("_range", "_before")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn(name, within).join(F.broadcast(before), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")
