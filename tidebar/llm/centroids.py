"""Exact k-means on integer vectors, its distances screened in float32.

A vector is kept when it has exactly `dims` components, none null or non-finite; component x becomes the integer floor(scale * x).
Each round assigns every vector to its nearest centroid and moves every non-empty centroid to the exact floor of its vectors' mean;
empty ones stay. The nearest centroid is found in two steps:

1. One float32 matrix product gives x . c for a block of vectors and all centroids. Each product sum has a rounding error of at most
   g |x| |c| with g = n u / (1 - n u), u = 2^-24 and n = dims + 2: dims - 1 additions and one product in whatever order the library
   takes them, and both factors rounded on their way to float32. So |c|^2 - 2 x . c lies in an interval that is known for certain.
2. A centroid whose interval begins above the lowest end of all intervals cannot be nearest. Where one is left it is the nearest;
   where several are, their distances are computed in 64-bit integers, and of equal ones the lowest number wins.

The distance returned is always the integer one. Centroids (k x dims integers) travel with the task's code; a task sends back k rows
of sums at most, which Spark adds up, so a round moves nothing that grows with the table.

Odd rows: null, short, long and non-finite vectors have no row in the result. Repeated vectors and ids count each time; rows that
share an id start as centroids in the order of their components. A null id gives a null vec_id and starts a centroid only after all
others. With fewer than k kept vectors there are as many centroids as vectors; an empty table gives no rows. Where two centroids are
equal, the lower number takes all and the other stays as it is. Components beyond +-2^27 are refused with an error: their squared
distances would not fit a long. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table

K, ROUNDS, SCALE, DIMS, SEED = 16, 3, 64, 64, "1"
LARGEST = 1 << 27
_U = 2.0**-24
#: Vectors in a block: 8 MB of integers.
BLOCK = 16_384


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest row of c for each row of x (both int64), its squared distance, and how many rows needed the exact step."""
    n = x.shape[1] + 2
    g = n * _U / (1 - n * _U)
    of_c = (c * c).sum(axis=1)
    # lengths are rounded up, and 2^-40 of all that is added covers the roundings of float64 below
    long_x, long_c = (np.sqrt((v.astype(np.float64) ** 2).sum(axis=1)) * (1 + 2.0**-40) for v in (x, c))
    middle = of_c.astype(np.float64) - 2.0 * (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    reach = 2 * g * long_x[:, None] * long_c + 2.0**-40 * (of_c + 2 * long_x[:, None] * long_c)
    possible = middle - reach <= (middle + reach).min(axis=1)[:, None]
    to = possible.argmax(axis=1)
    several = np.flatnonzero(possible.sum(axis=1) > 1)
    if len(several):
        row, number = np.nonzero(possible[several])
        exact = np.full((len(several), len(c)), np.iinfo(np.int64).max)
        for at in range(0, len(row), BLOCK):
            i, j = row[at : at + BLOCK], number[at : at + BLOCK]
            exact[i, j] = ((x[several[i]] - c[j]) ** 2).sum(axis=1)
        to[several] = exact.argmin(axis=1)
    return to, ((x - c[to]) ** 2).sum(axis=1), len(several)


def kept(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): the vectors that are kept, as integers."""
    v = F.col(vec_col).cast("array<double>")
    whole = F.size(v) == dims
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fits = F.forall(v, lambda x: F.abs(x) <= LARGEST / scale)
    refuse = F.raise_error(F.lit(f"a component is beyond {LARGEST}: squared distances would not fit a long"))
    ints = F.when(fits, F.transform(v, lambda x: F.floor(x * scale).cast("int"))).otherwise(refuse.cast("array<int>"))
    return vectors.where(v.isNotNull() & whole & fine).select(F.col(id_col).cast("long").alias("vec_id"), ints.alias("v"))


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part.column("vec_id"), part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _sums(c: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
        for _, x in _blocks(batches, c.shape[1]):
            to = nearest(x, c)[0]
            n += np.bincount(to, minlength=len(c))
            np.add.at(total, to, x)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(np.flatnonzero(n), pa.int32()), "n": n[n > 0], "total": pa.array(list(total[n > 0]), pa.list_(pa.int64()))})

    return run


def _assigned(c: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, c.shape[1]):
            to, far, _ = nearest(x, c)
            yield pa.RecordBatch.from_arrays([ids, pa.array(to, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def moved(vectors: DataFrame, c: np.ndarray) -> np.ndarray:
    """The centroids after one round; k x dims sums come to the driver, whatever the number of vectors."""
    parts = vectors.mapInArrow(_sums(c), "cluster int, n long, total array<long>")
    sums = parts.select("cluster", "n", F.posexplode("total").alias("at", "part")).groupBy("cluster", "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    out = c.copy()
    for r in sums.collect():
        out[r["cluster"], r["at"]] = int(r["s"]) // r["n"]
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, seed: str = SEED) -> DataFrame:
    """One row per kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    ints = cut(kept(vectors, id_col, vec_col, dims, scale))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = ints.orderBy(order.asc_nulls_last(), "v").limit(k).collect()
    c = np.array([r["v"] for r in first], np.int64).reshape(-1, dims)
    for _ in range(rounds if len(c) else 0):
        c = moved(ints, c)
    if not len(c):
        c = np.zeros((1, dims), np.int64)  # there is no vector to take it
    rows = cut(ints.mapInArrow(_assigned(c), "vec_id long, cluster int, distance long"))
    within = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # at most k rows
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c.tolist()]
    by = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    return rows.select(
        F.col("vec_id").alias(id_col), "cluster", "distance", by([within.get(i, 0) for i in range(len(c))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(within.values())).cast("long").alias("inertia"), by(digest).alias("centroid_sha256"),
    )


def op11_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    near = """a{r} AS (SELECT vec_id, u, arg_min(j, (d, j)) AS cluster, min(d) AS distance FROM (
  SELECT vec_id, u, j, CAST(list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v, c)]) AS BIGINT) AS d FROM k, c{r}) GROUP BY vec_id, u)"""
    move = """m{r} AS (SELECT cluster, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{r} JOIN k USING (u)) GROUP BY cluster, pos),
l{r} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS c FROM m{r} GROUP BY cluster),
c{s} AS (SELECT j, coalesce(l{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN l{r} ON l{r}.cluster = c{r}.j)"""
    parts = [", ".join([near.format(r=r), move.format(r=r, s=r + 1)]) for r in range(ROUNDS)]
    return f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, row_number() OVER () AS u FROM embeddings),
k AS (SELECT vec_id, u, [CAST(floor({SCALE} * y) AS BIGINT) FOR y IN x] AS v FROM e WHERE len(x) = {DIMS} AND len([1 FOR y IN x IF y IS NOT NULL AND isfinite(y)]) = {DIMS}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v) - 1 AS j, v AS c FROM k QUALIFY j < {K}),
{", ".join(parts)}, {near.format(r=ROUNDS)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON j = cluster
"""


OP11_SQL = _sql()
