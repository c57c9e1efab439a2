"""Sinks: results by category, rankings, candidate tiers, archives with a checksum, and a cache of features by request."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import DataError


def write_results(rows: DataFrame, path: str, category: str = "tp_category", task: str | None = None) -> None:
    """Parquet by category. A task writes its own folder over again, so a repeated attempt leaves nothing twice."""
    where = f"{path}/task={task}" if task else path
    rows.write.mode("overwrite" if task else "append").partitionBy(category).parquet(where)


def write_ranking(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_candidates(tiers: dict[str, DataFrame], path: str) -> None:
    """One CSV folder for each tier; nested columns as JSON text."""
    for name, rows in tiers.items():
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in rows.dtypes]
        rows.select(*flat).write.mode("overwrite").csv(f"{path}/{name}", header=True)


def content_digest(rows: DataFrame) -> str:
    """A digest of a table's rows that their order and distribution do not change: sums of row hashes, and their number."""
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})).cast("decimal(38,0)"))
    one = rows.agg(F.count("*"), h(1), h(2)).first()
    return hashlib.sha256("|".join(map(str, one)).encode()).hexdigest()


def archive(rows: DataFrame, path: str) -> str:
    """Compressed Parquet, read again and compared by digest before the caller may drop the original."""
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    before, after = content_digest(rows), content_digest(rows.sparkSession.read.schema(rows.schema).parquet(path))
    if before != after:
        raise DataError(f"the archive {path} differs from what was written")
    return after


def request_key(**request) -> str:
    return hashlib.sha256(json.dumps(request, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:16]


def cached(spark, folder: str, request: dict, source_digest: Callable[[], str], build: Callable[[], DataFrame]) -> DataFrame:
    """A table by its request and its sources' digest; refused if the sources change while it is built."""
    before = source_digest()
    path = f"{folder.rstrip('/')}/{request_key(source=before, **request)}"
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    table = build()
    if source_digest() != before:
        raise DataError("the sources changed while their features were built")
    table.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def verified_rerun(stored: DataFrame, again: DataFrame, key: str, *metrics: Column | str) -> DataFrame:
    """Keys whose repeated run does not give what is stored, either way round."""
    cols = [key, *metrics]
    a, b = stored.select(*cols), again.select(*cols)
    return a.exceptAll(b).select(key).unionByName(b.exceptAll(a).select(key)).distinct()
