"""Repeated byte strings across documents, found by a hash-compared suffix sort.

A byte goes when a string of `window` bytes that covers it also starts anywhere else, in the same document or another, judged on the
input. Windows meet through their anchors (anchors.py); whole classes of equal contexts are told by cryptographic digest, the
contexts of mixed anchor groups are cut out of the texts, dealt by anchor, and suffix-sorted block by block (suffix_sort.py). Anchor
groups of more than HOT classes, which one passage with many different surroundings makes, are not brought together: their windows
are counted by cryptographic digest with partial sums on the map side.

Null texts are empty; empty texts and texts under `window` bytes keep everything. Texts of any length are read whole, in chunks of
window starts. Repeated rows count as documents of their own, so rows that repeat (same id, same text) remove all their windows; of
equal strings none is kept, so ties do not arise. An empty table gives an empty result. Extra columns are ignored by the result and
may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from . import repeats
from .common import cut, id_of, keyed, rows_of, spans, table, text_bytes
from .suffix_sort import repeated

GRAM = 32


def _occurrences(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            data, where = text_bytes(batch.column("text"))
            kids, ktxs = batch.column("kid").to_numpy(), batch.column("ktx").to_numpy()
            raw, place = data.tobytes(), np.arange(len(data))
            for found in A.anchors(data, where, window, gram):
                yield repeats.occurrences(kids, ktxs, raw, place, place + 1, where, window, found)

    return run


def _contexts(window: int, hashed: bool):
    """The bytes of the contexts asked for, or the digests of their windows."""
    from hashlib import blake2b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            out: list[tuple] = []
            for kid, ktx, text, asked in zip(*(batch.column(x).to_pylist() for x in ("kid", "ktx", "text", "asked"))):
                data = text.encode("utf-8", "surrogatepass")
                for x in asked:
                    at, span = x["span"] >> 32, x["span"]
                    part = data[at - (span >> 16 & 0xFFFF) : at - (span & 0xFFFF) + window]
                    if hashed:
                        part = b"".join(blake2b(part[i : i + window], digest_size=16).digest() for i in range(len(part) - window + 1))
                    out.append((x["h"], kid, ktx, span, x["single"], part))
                    if len(out) >= 2048:
                        yield repeats.batch(repeats.ASKED, out)
                        out = []
            yield repeats.batch(repeats.ASKED, out)

    return run


def _sort(window: int):
    def compare(rows: list[dict], group: np.ndarray, anchor: np.ndarray, windows: np.ndarray) -> np.ndarray:
        size = np.array([len(r["data"]) for r in rows])
        return repeated(b"".join(r["data"] for r in rows), np.cumsum(size) - size, group, anchor, windows, window)

    return compare


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    i = pa.int64()
    schema = pa.schema([("kid", i), ("n_bytes", i), ("n_removed", i), ("n_spans", i), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("spans", pa.list_(pa.list_(i)))])
    for batch in rows_of(batches):
        out = []
        for kid, ktx, text, cover in zip(*(batch.column(x).to_pylist() for x in ("kid", "ktx", "text", "cover"))):
            kid = id_of(kid, ktx)
            data = text.encode("utf-8", "surrogatepass")
            runs = spans([x["a"] for x in cover or ()], [x["b"] for x in cover or ()])
            kept = b"".join(data[a:b] for a, b in zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), len(data)]))
            out.append((kid, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept, runs))
        yield repeats.batch(schema, out)


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 400, gram: int = GRAM, hot: int = repeats.HOT) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, the kept bytes and the removed spans."""
    texts = keyed(docs, id_col, text_col)
    occ = repeats.meeting(cut(texts.mapInArrow(_occurrences(window, gram), repeats.OCC_DDL)))
    cover = repeats.removed(texts, occ, window, hot, _contexts(window, False), _contexts(window, True), _sort(window))
    out = texts.join(cover, ["kid", "ktx"], "left").mapInArrow(_rest, "kid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<array<long>>")
    return out.select(F.col("kid").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
