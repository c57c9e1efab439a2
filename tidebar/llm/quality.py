"""Quality rules: base counts and compression bands.

Base counts are taken over the words [^\\x20\\x09-\\x0D]+ of the whole text. The method's verdict comes from zstandard ratios (compressed
bytes over bytes): of the whole text, and of its successive chunks of CHUNK bytes. A text or chunk whose ratio is below its band is
repetitive, above it is incompressible. How far text compresses depends on how much of it there is, so the bands depend on the
length (BANDS: from so many bytes on, low, high). A text is rejected if its own ratio is outside its band or more than CHUNK_SHARE of
its chunks are outside theirs; texts shorter than the first band are judged by the base rules alone.

Null and empty texts have no words and fail the base rules. Texts of any length are read whole. Repeated rows get equal results; each
row is judged by itself, so ties do not arise. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, table

CHUNK, CHUNK_SHARE, LEVEL = 4096, 0.5, 3
#: From so many bytes on: the lowest and the highest ratio of ordinary text.
BANDS = ((200, 0.25, 0.95), (500, 0.25, 0.85), (1_000, 0.22, 0.78), (4_000, 0.20, 0.72), (16_000, 0.17, 0.70), (65_536, 0.15, 0.68))
_SYMBOLS = re.compile(r"[#*$%&|<>]")


def words_of(text: str) -> list[str]:
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]


def base(text: str | None) -> tuple[int, int, int, int, int, bool]:
    text = text or ""
    words = words_of(text)
    n = len(words)
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    seen = Counter(windows)
    repeated = 0
    if len(seen) < len(windows):
        upto = 0
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 5 - max(i, upto)
                upto = i + 5
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return n, sum(map(len, words)), len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated, n < 10 or 100 * repeated > 20 * n


def band(size: int) -> tuple[float, float] | None:
    return next(((low, high) for least, low, high in reversed(BANDS) if size >= least), None)


def outside(ratio: float, size: int) -> int:
    """-1 repetitive, 1 incompressible, 0 in its band or too short to tell."""
    limits = band(size)
    return 0 if limits is None else -1 if ratio < limits[0] else 1 if ratio > limits[1] else 0


def ratios(data: bytes, compress) -> tuple[float | None, list[tuple[float, int]]]:
    whole = len(compress(data)) / len(data) if data else None
    parts = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
    return whole, [(len(compress(p)) / len(p), len(p)) for p in parts] if len(parts) > 1 else []


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    i = pa.int64()
    schema = pa.schema([("doc_id", i), ("n_words", i), ("word_chars", i), ("n_symbols", i), ("n_dup_lines", i), ("n_repeat_words", i), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("n_chunks", i), ("n_low_chunks", i), ("n_high_chunks", i)])
    for batch in rows_of(batches):
        out = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            counts = base(text)
            data = (text or "").encode("utf-8", "surrogatepass")
            whole, parts = ratios(data, compress)
            signs = [outside(r, n) for r, n in parts]
            fine = whole is not None and not outside(whole, len(data)) and sum(map(abs, signs)) <= CHUNK_SHARE * len(signs)
            out.append((doc_id, *counts, fine and not counts[-1], whole, len(parts), signs.count(-1), signs.count(1)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, base counts, base_failed, kept, and the ratios behind the verdict."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ddl = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_low_chunks long, n_high_chunks long"
    return texts.mapInArrow(_rules, ddl).withColumnRenamed("doc_id", id_col)


def op1_compression_bands(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
