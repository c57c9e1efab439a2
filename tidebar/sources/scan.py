"""Scans: CSV, Parquet and ZIP bundles of bars, trades and sparse state feeds."""

from __future__ import annotations

import re
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..core import DataError

#: What a bundle's member is, by its name.
KINDS = {
    "trades": re.compile(r"(agg)?trades", re.I),
    "micro": re.compile(r"micro|flow", re.I),
    "funding": re.compile(r"funding", re.I),
    "oi": re.compile(r"open_?interest|(^|[^a-z])oi([^a-z]|$)|metrics", re.I),
    "bars": re.compile(r"klines|bars|ohlcv|1m", re.I),
}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file or folder with a header, all columns as text so that bad numbers are seen; Parquet with its own types."""
    if re.search(r"\.(parquet|pq)/?$", path):
        return spark.read.parquet(path)
    if re.search(r"\.csv(\.gz)?/?$", path):
        return spark.read.csv(path, header=True, inferSchema=False, mode="FAILFAST")
    raise DataError(f"neither CSV nor Parquet: {path}")


def kind_of(name: str) -> str | None:
    stem = Path(name).name
    return next((k for k, p in KINDS.items() if p.search(stem)), None)


def open_bundle(path: str, target: str) -> dict[str, str]:
    """Unpack a ZIP bundle into the shared folder `target`; exactly one member of a kind, more are an error."""
    found: dict[str, str] = {}
    with zipfile.ZipFile(path) as z:
        for member in z.infolist():
            if member.is_dir() or not re.search(r"\.(csv|csv\.gz|parquet|pq)$", member.filename):
                continue
            kind = kind_of(member.filename)
            if kind is None:
                continue
            if kind in found:
                raise DataError(f"two members are {kind}: {found[kind]}, {member.filename}")
            found[kind] = z.extract(member, target)
    return found


def resolve(bundle: dict[str, str], **explicit: str | None) -> dict[str, str]:
    """Paths given one by one come before the bundle's."""
    return bundle | {k: v for k, v in explicit.items() if v}
