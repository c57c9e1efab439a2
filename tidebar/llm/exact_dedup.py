"""Exact duplicates by a tree merge of sorted digest runs.

Texts are equal when they are identical after each run of white space [\\x20\\x09-\\x0D] became one space; a null text is empty. Each
task turns its rows into sorted runs of (SHA-256 and length, smallest id, rows), one run for each range of digests, its own copies
already summed. In round after round the runs of two neighbours meet (binomial rounds: after k rounds a run stands for 2^k tasks) and
a merge of sorted runs keeps, for each digest, the smallest identifier and the sum; the length beside the digest is verified at every
level. After the last round each range has one run. Ranges share no digest and their number follows that of the digests, so no task holds more than about PER_RANGE of them,
however many copies a text has; runs travel as rows of bounded blocks.

Null ids come after all others, by a flag beside the id, so every 64-bit id is an id: keep_id is null only where every copy has a null id. Where rows repeat with the id that stays, one
of them is kept. Texts of any length are digested whole. Empty tables give no rows. Extra columns are carried by `drop_copies` and ignored by `copies`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table

FAN = 2
_NAMES = ("keys", "ids", "without", "sizes")
_RUN = "range int, node int, at int, keys binary, ids binary, without binary, sizes binary"
_RUN_SCHEMA = pa.schema([("range", pa.int32()), ("node", pa.int32()), ("at", pa.int32()), *((c, pa.binary()) for c in _NAMES)])
_KEY = 40
#: Digests in a range, and in a cell of a run: 56 MB of a range pass a task, and no cell has more than 4 MB.
PER_RANGE, BLOCK = 1_000_000, 1 << 16
#: Rows that a task sorts at once; its runs are merged as they come, so that it sends one.
MOST = 1_000_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


#: A run: keys in order, none twice; their smallest ids, whether all their rows are without an id (the id says nothing then), their rows.
Run = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
_HIGHEST = np.iinfo(np.int64).max


def _verified(keys: np.ndarray) -> None:
    digest, length = keys.view("S1").reshape(-1, _KEY)[:, :32], keys.view("S1").reshape(-1, _KEY)[:, 32:]
    if ((digest[1:] == digest[:-1]).all(axis=1) & (length[1:] != length[:-1]).any(axis=1)).any():
        raise ValueError("two texts of different length share a SHA-256 digest")


def sorted_run(keys: np.ndarray, ids: np.ndarray, without: np.ndarray, sizes: np.ndarray) -> Run:
    """A run of rows in any order."""
    order = np.argsort(keys, kind="stable")
    keys, ids, without, sizes = keys[order], np.where(without, _HIGHEST, ids)[order], without[order], sizes[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    out = keys[head], np.minimum.reduceat(ids, head), np.logical_and.reduceat(without, head), np.add.reduceat(sizes, head)
    _verified(out[0])
    return out


def merged(a: Run, b: Run) -> Run:
    """Two runs as one: each key of the second finds its place in the first; the smallest id and the sum of what meets."""
    if not len(a[0]) or not len(b[0]):
        return a if len(a[0]) else b
    at = np.searchsorted(a[0], b[0])
    there = np.minimum(at, len(a[0]) - 1)
    both = a[0][there] == b[0]
    k = there[both]
    ids, without, sizes = a[1].copy(), a[2].copy(), a[3].copy()
    x, y = np.where(without[k], _HIGHEST, ids[k]), np.where(b[2][both], _HIGHEST, b[1][both])
    ids[k], without[k], sizes[k] = np.minimum(x, y), without[k] & b[2][both], sizes[k] + b[3][both]
    new = ~both
    out = tuple(np.insert(u, at[new], v[new]) for u, v in zip((a[0], ids, without, sizes), b))
    _verified(out[0])
    return out


def _packed(rng: int, node: int, run: Run) -> list[tuple]:
    """A run as rows of bounded blocks, in order."""
    return [(rng, node, k, *(x[i : i + BLOCK].tobytes() for x in run)) for k, i in enumerate(range(0, len(run[0]), BLOCK))]


def _unpacked(keys: bytes, ids: bytes, without: bytes, sizes: bytes) -> Run:
    return np.frombuffer(keys, f"S{_KEY}"), np.frombuffer(ids, np.int64), np.frombuffer(without, bool), np.frombuffer(sizes, np.int64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RUN_SCHEMA)], schema=_RUN_SCHEMA)


def _runs(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        node, whole, held, rows = TaskContext.get().partitionId(), None, [], 0

        def gathered() -> Run:
            own = sorted_run(*(np.concatenate(x) for x in zip(*held)))
            return own if whole is None else merged(whole, own)

        def out(run: Run) -> pa.RecordBatch:
            which = run[0].view("S1").reshape(-1, _KEY)[:, :4].copy().view(">u4").ravel().astype(np.int64) * ranges >> 32
            cuts = np.searchsorted(which, np.arange(ranges + 1))
            return _batch([x for r, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j for x in _packed(r, node, tuple(c[i:j] for c in run))])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("doc_id")
            held.append((np.array(batch.column("key").to_pylist(), f"S{_KEY}"), ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), batch.column("m").to_numpy()))
            rows += batch.num_rows
            if rows >= MOST:
                whole, held, rows = gathered(), [], 0
        if held:
            whole = gathered()
        if whole is not None:
            yield out(whole)

    return run


def _merge(fan: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("node", "ascending"), ("at", "ascending")])
        blocks: dict[int, list[Run]] = {}
        for node, *cells in zip(*(group.column(c).to_pylist() for c in ("node", *_NAMES))):
            blocks.setdefault(node, []).append(_unpacked(*cells))
        one = None
        for parts in blocks.values():
            own = tuple(np.concatenate(x) for x in zip(*parts))
            one = own if one is None else merged(one, own)
        return pa.Table.from_batches([_batch(_packed(group.column("range")[0].as_py(), group.column("node")[0].as_py() // fan, one))])

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
    for batch in batches:
        for cells in zip(*(batch.column(c).to_pylist() for c in _NAMES)):
            keys, ids, without, sizes = _unpacked(*cells)
            fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(_KEY), len(keys), [None, pa.py_buffer(cells[0])]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([fixed, pa.array(ids, mask=without), pa.array(sizes)], schema=schema)


def tree_merge(digests: DataFrame, ranges: int, fan: int = FAN) -> DataFrame:
    """(key, keep_id, group_size) of all keys, from rows (doc_id, key, m)."""
    nodes = max(1, digests.rdd.getNumPartitions())
    runs = digests.select("doc_id", "key", "m").mapInArrow(_runs(ranges), _RUN)
    while True:
        runs = runs.groupBy("range", F.floor(F.col("node") / fan).alias("parent")).applyInArrow(_merge(fan), _RUN)
        nodes = -(-nodes // fan)
        if nodes <= 1:
            return runs.mapInArrow(_rows, "key binary, keep_id long, group_size long")


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, rid): each row's id, its text's digest and length, and a number of its own."""
    text = normalised(F.col(text_col))
    key = F.concat(F.unhex(F.sha2(text, 256)), F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")))
    return cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), F.monotonically_increasing_id().alias("rid")))


def _digests(keys: DataFrame) -> DataFrame:
    return cut(keys.groupBy("doc_id", "key").agg(F.count("*").alias("m"), F.min("rid").alias("first")))


def _ranges(digests: DataFrame) -> int:
    """So many ranges that a range's run stays below PER_RANGE digests (they are spread evenly), and the tasks have work."""
    rows = digests.count()
    return max(1, int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PER_RANGE))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    keys = _keys(docs, id_col, text_col)
    digests = _digests(keys)
    groups = tree_merge(digests, _ranges(digests))
    # rows that repeat an id with its text: the first of them
    again = digests.where("m > 1").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "first")
    rows = keys.join(groups, "key").join(again, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("rid") == F.coalesce("first", "rid"))
    return rows.select(F.col("doc_id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    digests = _digests(_keys(docs, id_col, text_col))
    groups = tree_merge(digests, _ranges(digests))
    # only rows of repeated (id, text) need telling apart, and only they are looked at again
    stay = digests.join(groups, "key").where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias("_keep"), F.substring("key", 1, 32).alias("_sha"), F.col("m").alias("_m"))
    rows = docs.withColumns({"_row_id": F.col(id_col).cast("long"), "_row_sha": F.unhex(F.sha2(normalised(F.col(text_col)), 256))})
    rows = rows.join(stay, F.col("_row_id").eqNullSafe(F.col("_keep")) & (F.col("_row_sha") == F.col("_sha")))
    once = rows.where("_m = 1").select(docs.columns)
    again = rows.where("_m > 1").dropDuplicates(["_keep", "_sha"]).select(docs.columns)
    return once.unionByName(again)


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER (PARTITION BY text_sha256, doc_id) AS nth FROM d
)
SELECT doc_id, keep_id, group_size, nth = 1 AND doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""
