"""Repeated passages of words across documents, behind a count-min prefilter.

A word goes when a window of `window` successive words that covers it also starts anywhere else. First pass: each task counts the
windows of its texts in a count-min sketch, each under the anchor that it owns (anchors.py): about thirteen windows share a counter,
without which the partial sketches would be four times the input. It hands out the counters that are not zero; they are merged slice
by slice. A window's count is never above its anchor's, and a sketch never counts too low, so a window whose estimate is one is
unique. Second pass: only windows estimated repeated are handed on and grouped exactly, on the words themselves. The sketch has DEPTH
rows of counters, two for each anchor to be expected up to WIDEST a row, sent on as one bit each; so what is broadcast has a bound
(48 MiB). On more data than it has room for, more unique windows reach the exact grouping, which first drops the anchors that
stand alone, and none is lost.

Null texts have no words; shorter texts than a window keep everything. Texts of any length are read whole. Repeated rows count as
documents of their own; of equal windows none is kept, so ties do not arise. An empty table gives an empty result. Extra columns are
ignored and may have any name.
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
from .common import cut, id_of, keyed, mix, rows_of, spans, table, text_bytes, word_hashes, word_places

#: Words of an anchor. Fewer would repeat by chance, the more the larger the corpus: of invented prose a third of all five-word ones on 0.1 GB.
GRAM = 11
DEPTH, LEAST, WIDEST = 3, 1 << 20, 1 << 27
#: Counters of a sketch that are merged together.
SLICE = 1 << 20
#: Bytes of text to an anchor of 35-word windows, about.
PER_ANCHOR = 80


def width_for(n_bytes: int) -> int:
    """Counters in a row of the sketch of so many bytes of text: a power of two, two or more for each anchor up to the widest."""
    return min(WIDEST, max(LEAST, 1 << max(0, 2 * n_bytes // PER_ANCHOR - 1).bit_length()))


def counters(h: np.ndarray, width: int) -> np.ndarray:
    """The DEPTH counters of each hash."""
    with np.errstate(over="ignore"):
        return np.stack([(mix(h + np.uint64(d * 0x9E3779B97F4A7C15 % 2**64)) & np.uint64(width - 1)).astype(np.int64) + d * width for d in range(DEPTH)])


def _sequences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Word hashes of all texts in a row, where each text begins, and the words: bytes with their begins and ends."""
    data, where = text_bytes(batch.column("text"))
    begin, end, words = word_places(data, where)
    return word_hashes(data, begin, end), words, (data, begin, end)


def _joined(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words with one space after each, and their begins and ends there."""
    size = end - begin
    at = np.cumsum(size + 1) - size - 1
    word = np.repeat(np.arange(len(size)), size)
    out = np.full(int(size.sum()) + len(size), 32, np.uint8)
    out[np.arange(len(word)) + word] = data[np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)]
    return out.tobytes(), at, at + size


def _sketch(window: int, gram: int, width: int):
    schema = pa.schema([("slice", pa.int32()), ("at", pa.binary()), ("n", pa.binary())])
    slices = DEPTH * width // SLICE

    def rows(seen: list[np.ndarray]) -> pa.RecordBatch:
        at, n = np.unique(np.concatenate(seen), return_counts=True)
        cuts = np.searchsorted(at, np.arange(slices + 1) * SLICE)
        out = [(s, (at[i:j] - s * SLICE).astype("<u4").tobytes(), np.minimum(n[i:j], 255).astype(np.uint8).tobytes()) for s, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        for batch in rows_of(batches):
            seen += [counters(found[1], width).ravel() for found in A.anchors(*_sequences(batch)[:2], window, gram)]
            if sum(map(len, seen)) > 6_000_000:
                yield rows(seen)
                seen = []
        if seen:
            yield rows(seen)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the counters of a slice as its rows pass; hands out one bit a counter: two or more."""
    now, total = None, None
    schema = pa.schema([("slice", pa.int32()), ("bits", pa.binary())])

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= 2).tobytes()], pa.binary())], schema=schema)

    for batch in batches:
        for s, at, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if s != now:
                if now is not None:
                    yield done()
                now, total = s, np.zeros(SLICE, np.uint8)
            at, n = np.frombuffer(at, "<u4"), np.frombuffer(n, np.uint8)
            total[at] = np.minimum(total[at].astype(np.uint16) + n, 255).astype(np.uint8)
    if now is not None:
        yield done()


def count_min(texts: DataFrame, window: int, gram: int = GRAM, width: int | None = None) -> np.ndarray:
    """The merged sketch as packed bits: whether a counter is two or more. The driver holds no more than DEPTH x WIDEST bits."""
    if width is None:
        width = width_for(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    part = texts.select("text").mapInArrow(_sketch(window, gram, width), "slice int, at binary, n binary")
    whole = part.repartition("slice").sortWithinPartitions("slice").mapInArrow(_merged, "slice int, bits binary")
    bits = np.zeros(DEPTH * width // 8, np.uint8)
    for row in whole.toLocalIterator():
        at = row["slice"] * SLICE // 8
        bits[at : at + SLICE // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits


def _estimated(bits, window: int, gram: int):
    """Occurrences of the anchors that the sketch counts twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = bits.value
        width = len(sketch) * 8 // DEPTH
        for batch in rows_of(batches):
            hashed, where, words = _sequences(batch)
            kids, ktxs = batch.column("kid").to_numpy(), batch.column("ktx").to_numpy()
            joined = _joined(*words)
            for found in A.anchors(hashed, where, window, gram):
                at = counters(found[1], width)
                twice = ((sketch[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)
                yield repeats.occurrences(kids, ktxs, *joined, where, window, tuple(x[twice] for x in found))

    return run


def _contexts(window: int, hashed: bool):
    """The words of the contexts asked for, joined by spaces, or the digests of their windows."""
    from hashlib import blake2b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            out: list[tuple] = []
            for kid, ktx, text, asked in zip(*(batch.column(x).to_pylist() for x in ("kid", "ktx", "text", "asked"))):
                words = text.encode("utf-8", "surrogatepass").split()
                for x in asked:
                    at, span = x["span"] >> 32, x["span"]
                    part = words[at - (span >> 16 & 0xFFFF) : at - (span & 0xFFFF) + window]
                    if hashed:
                        data = b"".join(blake2b(b" ".join(part[i : i + window]), digest_size=16).digest() for i in range(len(part) - window + 1))
                    else:
                        data = b" ".join(part)
                    out.append((x["h"], kid, ktx, span, x["single"], data))
                    if len(out) >= 2048:
                        yield repeats.batch(repeats.ASKED, out)
                        out = []
            yield repeats.batch(repeats.ASKED, out)

    return run


def _count(window: int):
    """Exact grouping of the windows of a block by anchor group, the anchor's place in them, and their words.

    Windows meet by hash; runs of them that two contexts share are then compared as bytes, and where a hash lied, all of its windows."""

    def compare(rows: list[dict], group: np.ndarray, anchor: np.ndarray, windows: np.ndarray) -> np.ndarray:
        raw = b"".join(r["data"] for r in rows)
        data = np.frombuffer(raw, np.uint8)
        where = np.concatenate([[0], np.cumsum([len(r["data"]) for r in rows])])
        begin, end, words = word_places(data, where)
        context = np.repeat(np.arange(len(rows)), windows)
        t = np.arange(len(context)) - np.repeat(np.cumsum(windows) - windows, windows)
        first = words[context] + t  # the first word of each window
        hashed = A.gram_hashes(word_hashes(data, begin, end), window)[first]
        offset, group = anchor[context] - t, group[context]
        order = np.lexsort((hashed, offset, group))
        same = (hashed[order][1:] == hashed[order][:-1]) & (offset[order][1:] == offset[order][:-1]) & (group[order][1:] == group[order][:-1])
        key = np.cumsum(np.concatenate([[True], ~same]))
        a, b = order[:-1][same], order[1:][same]
        flag = np.zeros(len(context), bool)
        by = np.lexsort((t[a], context[b], context[a]))
        a, b = a[by], b[by]
        cuts = np.flatnonzero((context[a][1:] != context[a][:-1]) | (context[b][1:] != context[b][:-1]) | (t[a][1:] != t[a][:-1] + 1)) + 1
        lied: set[int] = set()
        for i, j in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(a)]])) if len(a) else ():
            p, q = a[i:j], b[i:j]
            if raw[begin[first[p[0]]] : end[first[p[-1]] + window - 1]] == raw[begin[first[q[0]]] : end[first[q[-1]] + window - 1]]:
                flag[p] = flag[q] = True
            else:
                lied.update(key[np.isin(order, np.concatenate([p, q]))].tolist())
        for k in lied:
            met: dict[bytes, list[int]] = {}
            for x in order[key == k]:
                met.setdefault(raw[begin[first[x]] : end[first[x] + window - 1]], []).append(int(x))
            for xs in met.values():
                flag[xs] = flag[xs] | (len(xs) > 1)
        return flag

    return compare


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    i = pa.int64()
    schema = pa.schema([("kid", i), ("n_words", i), ("n_removed", i), ("kept_sha256", pa.string()), ("kept", pa.string())])
    for batch in rows_of(batches):
        data, where = text_bytes(batch.column("text"))
        begin, end, words = word_places(data, where)
        out = []
        for kid, ktx, cover, i, j in zip(*(batch.column(x).to_pylist() for x in ("kid", "ktx", "cover")), words.tolist(), words[1:].tolist()):
            kid = id_of(kid, ktx)
            runs = spans([x["a"] for x in cover or ()], [x["b"] for x in cover or ()])
            stay = [(i + a, i + b) for a, b in zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), j - i]) if a < b]
            kept = b" ".join(b" ".join(data[begin[a] : end[b - 1]].tobytes().split()) for a, b in stay)
            out.append((kid, j - i, sum(b - a for a, b in runs), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
        yield repeats.batch(schema, out)


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, gram: int = GRAM, hot: int = repeats.HOT) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256 and the kept words joined by spaces."""
    texts = keyed(docs, id_col, text_col)
    bits = docs.sparkSession.sparkContext.broadcast(count_min(texts, window, gram))
    # what the sketch lets through by chance goes by exact counts of anchors
    occ = repeats.meeting(cut(texts.mapInArrow(_estimated(bits, window, gram), repeats.OCC_DDL)))
    cover = repeats.removed(texts, occ, window, hot, _contexts(window, False), _contexts(window, True), _count(window))
    rest = texts.join(cover, ["kid", "ktx"], "left").mapInArrow(_rest, "kid long, n_words long, n_removed long, kept_sha256 string, kept string")
    return rest.select(F.col("kid").alias(id_col), "n_words", "n_removed", "kept_sha256", "kept")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
