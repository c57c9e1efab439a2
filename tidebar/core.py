"""Session settings and small helpers that the rest shares.

Missing values are NULL everywhere, never NaN: Spark takes NaN as larger than any number and equal to itself, while a rule must not
fire on what is missing. Time is UTC and, inside tables, a BIGINT of milliseconds.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MINUTE = 60_000
DAY = 86_400_000


def session(app: str = "tidebar", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive plans and skew handling; further settings as given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return builder.config(map=base | conf).getOrCreate()


class DataError(ValueError):
    """The data break a contract; the message says which and how often."""


def require(df: DataFrame, **broken: Column) -> DataFrame:
    """df, after one pass that found no row for which a named condition holds."""
    counts = df.agg(*(F.count_if(c).alias(n) for n, c in broken.items())).first()
    found = {n: counts[n] for n in broken if counts[n]}
    if found:
        raise DataError("; ".join(f"{n}: {k} rows" for n, k in found.items()))
    return df


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, deleted when it ends. Without that setting a local folder serves a local
    master (tests); on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tidebar-")
        spark.conf.set("spark.checkpoint.dir", where)
    path = f"{where.rstrip('/')}/tidebar-core-{spark.sparkContext.applicationId}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return path


def store(df: DataFrame, *partition_by: str) -> DataFrame:
    """df as a table in the shared checkpoint folder, read back; lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    writer = df.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
