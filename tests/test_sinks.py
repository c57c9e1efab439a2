import zipfile

import pytest

from tidebar.core import DataError
from tidebar.sources import scan, sinks


def test_archive_cache_and_rerun(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", [1.0]), (2, "b", None), (2, "b", None)], "id int, tp_category string, x array<double>")
    assert sinks.content_digest(rows) == sinks.content_digest(rows.repartition(3)) != sinks.content_digest(rows.limit(2))
    assert sinks.archive(rows, str(tmp_path / "a")) == sinks.content_digest(rows)
    for _ in range(2):
        sinks.write_results(rows, str(tmp_path / "r"), task="t1")
    assert spark.read.parquet(str(tmp_path / "r")).count() == 3
    sinks.write_candidates({"top": rows}, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c/top"), header=True).count() == 3
    built = []
    make = lambda: built.append(1) or rows
    for _ in range(2):
        assert sinks.cached(spark, str(tmp_path / "f"), {"tf": 5}, lambda: "same", make).count() == 3
    assert len(built) == 1
    digests = iter("ab")
    with pytest.raises(DataError):
        sinks.cached(spark, str(tmp_path / "g"), {}, lambda: next(digests), make)
    assert [r[0] for r in sinks.verified_rerun(rows, rows.limit(2), "id", "tp_category").collect()] == [2]
    assert sinks.request_key(a=1, b=2) == sinks.request_key(b=2, a=1)


def test_bundles(spark, tmp_path):
    path = tmp_path / "b.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("X-1m-klines.csv", "openTime,close\n1,2\n")
        z.writestr("X-fundingRate.csv", "time,fundingRate\n1,2\n")
        z.writestr("notes.txt", "x")
    found = scan.open_bundle(str(path), str(tmp_path / "out"))
    assert sorted(found) == ["bars", "funding"] and scan.read_table(spark, found["bars"]).first()["close"] == "2"
    assert scan.resolve(found, bars="/other", oi=None)["bars"] == "/other"
    with zipfile.ZipFile(path, "a") as z:
        z.writestr("Y-1m-klines.csv", "openTime,close\n")
    with pytest.raises(DataError):
        scan.open_bundle(str(path), str(tmp_path / "out"))
    with pytest.raises(DataError):
        scan.read_table(spark, "/x/y.xlsx")
