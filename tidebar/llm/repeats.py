"""What the two repeated-passage operators share: from anchor occurrences to the intervals to remove.

An occurrence is a row (h, c, d, kid, ktx, span): the anchor's hash, a cryptographic 128-bit digest (c, d) of the bytes that its
windows span together with their layout, the document's key, and the anchor's place with its first and last window start, packed.
Occurrences with equal digests form a class. A class of two or more is repeated as it stands; only in an anchor group of two or more
classes can the windows of a class of one be repeated elsewhere, and only there windows are compared one by one, on their bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

_I = pa.int64()
OCC = pa.schema([("h", _I), ("c", _I), ("d", _I), ("kid", _I), ("ktx", _I), ("span", _I)])
OCC_DDL = "h long, c long, d long, kid long, ktx long, span long"
ASKED_DDL = "h long, kid long, ktx long, span long, single boolean, data binary"
ASKED = pa.schema([("h", _I), ("kid", _I), ("ktx", _I), ("span", _I), ("single", pa.bool_()), ("data", pa.binary())])
CUT_DDL = "kid long, ktx long, a int, b int"
CUT = pa.schema([("kid", _I), ("ktx", _I), ("a", pa.int32()), ("b", pa.int32())])
#: Anchor groups with more classes than this have their windows counted instead of compared in one block.
HOT = 2048
#: Anchor groups are taken in blocks of about so many bytes.
BLOCK = 1 << 19


def place(span: Column) -> Column:
    return F.shiftright(span, 32)


def first(span: Column) -> Column:
    return place(span) - F.shiftright(span, 16).bitwiseAND(0xFFFF)


def last(span: Column) -> Column:
    return place(span) - span.bitwiseAND(0xFFFF)


def batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def occurrences(kids: np.ndarray, ktxs: np.ndarray, raw: bytes, begins: np.ndarray, ends: np.ndarray, where: np.ndarray, window: int, found: tuple) -> pa.RecordBatch:
    """Rows of the anchors found; symbol i of the sequences stands in raw from begins[i] to ends[i]."""
    from hashlib import blake2b

    from .anchors import packed
    from .common import mix

    seq, h, at, lo, hi = found
    view = memoryview(raw)
    digest = b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in zip(begins[lo].tolist(), ends[hi + window - 1].tolist())])
    c, d = np.frombuffer(digest, np.uint64).reshape(-1, 2).T
    begin = where[seq]
    cols = h.view(np.int64), (c ^ mix(at - lo)).view(np.int64), np.ascontiguousarray(d).view(np.int64), kids[seq], ktxs[seq], packed(at - begin, lo - begin, hi - begin)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, OCC)], schema=OCC)


def meeting(occ: DataFrame) -> DataFrame:
    """The occurrences of anchors that stand in two places or more."""
    several = cut(occ.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h"))
    # the same plan at every size: a small table of anchors would be broadcast, a larger one not
    return cut(occ.join(several.hint("merge"), "h", "left_semi"))


def classes(occ: DataFrame) -> DataFrame:
    """One row per class: its size n, one occurrence of it, and the number of classes of its anchor group (null: it is the only one)."""
    one = cut(occ.groupBy("h", "c", "d").agg(F.count("*").alias("n"), F.min(F.struct("kid", "ktx", "span")).alias("one")))
    # aggregates are written before they are joined: Spark splits a hot key only between plain exchanges
    group = cut(one.groupBy("h").agg(F.count("*").alias("n_classes")).where("n_classes > 1"))
    return one.join(group, "h", "left")


def asked(cls: DataFrame, hot: int, which: bool) -> DataFrame:
    """(kid, ktx, asked): for each document, one occurrence of those of its classes that need their windows compared."""
    rows = cls.where((F.col("n_classes") > hot) if which else (F.col("n_classes") <= hot) & (F.col("n_classes") > 1))
    return rows.select("one.kid", "one.ktx", F.struct("h", "one.span", (F.col("n") == 1).alias("single")).alias("x")).groupBy("kid", "ktx").agg(F.collect_list("x").alias("asked"))


def removed(texts: DataFrame, occ: DataFrame, window: int, hot: int, context: Callable, hashes: Callable, compare: Callable) -> DataFrame:
    """(kid, ktx, cover): the intervals of each document's symbols that repeated windows cover.

    context and hashes: mapInArrow functions from (kid, ktx, text, asked) to rows ASKED with what `compare` needs, or with the
    16-byte digests of the windows. compare: from the rows of whole anchor groups to a flag per window, contexts in a row."""
    cls = cut(classes(occ))
    many = cls.where("n > 1").select("c", "d")
    span = F.col("span")
    whole = occ.join(many.hint("merge"), ["c", "d"], "left_semi").select("kid", "ktx", first(span).cast("int").alias("a"), (last(span) + window).cast("int").alias("b"))
    # all joins with texts take the same exchange of them, at every size
    cold = texts.join(asked(cls, hot, False).hint("merge"), ["kid", "ktx"]).mapInArrow(context, ASKED_DDL)
    found = cold.repartition("h").sortWithinPartitions("h").mapInArrow(in_blocks(compare, window), CUT_DDL)
    cuts = whole.unionByName(found)
    if not cls.where(F.col("n_classes") > hot).isEmpty():
        win = texts.join(asked(cls, hot, True), ["kid", "ktx"]).mapInArrow(hashes, ASKED_DDL)
        win = win.select("h", "kid", "ktx", "span", "single", F.explode(F.sequence(F.lit(0), (F.octet_length("data") / 16 - 1).cast("int"))).alias("i"), "data")
        win = cut(win.select("h", (place(span) - first(span) - F.col("i")).cast("int").alias("o"), F.expr("substring(data, i * 16 + 1, 16)").alias("w"), "kid", "ktx", (first(span) + F.col("i")).cast("int").alias("a"), "single"))
        twice = cut(win.groupBy("h", "o", "w").agg(F.count("*").alias("m")).where("m > 1").select("h", "o", "w"))
        cuts = cuts.unionByName(win.where("single").join(twice, ["h", "o", "w"], "left_semi").select("kid", "ktx", "a", (F.col("a") + window).alias("b")))
    return cuts.groupBy("kid", "ktx").agg(F.collect_set(F.struct("a", "b")).alias("cover"))


def in_blocks(compare: Callable, window: int):
    """Rows come by anchor; blocks end between groups."""

    def solve(rows: list[dict]) -> pa.RecordBatch:
        span = np.array([r["span"] for r in rows])
        at = span >> 32
        lo, hi = at - (span >> 16 & 0xFFFF), at - (span & 0xFFFF)
        windows = hi - lo + 1
        flag = compare(rows, np.unique(np.array([r["h"] for r in rows]), return_inverse=True)[1], at - lo, windows)
        flag &= np.repeat(np.array([r["single"] for r in rows]), windows)
        begin = np.cumsum(windows) - windows
        starts = np.zeros(len(flag) + 1, bool)
        starts[begin] = True  # runs of flags end with their context
        on, off = flag & (starts[:-1] | ~np.concatenate([[False], flag[:-1]])), flag & (starts[1:] | ~np.concatenate([flag[1:], [False]]))
        a, b = np.flatnonzero(on), np.flatnonzero(off)
        k = np.searchsorted(begin, a, "right") - 1
        kid, ktx = np.array([r["kid"] for r in rows], np.int64), np.array([r["ktx"] for r in rows], np.int64)
        cols = kid[k], ktx[k], lo[k] + a - begin[k], lo[k] + b - begin[k] + window
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, CUT)], schema=CUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for part in batches:
            for row in part.to_pylist():
                if size >= BLOCK and row["h"] != held[-1]["h"]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["data"])
        if held:
            yield solve(held)

    return run
