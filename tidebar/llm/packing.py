"""Best-fit decreasing packing of token sequences.

A document is its ids and one end id. Longer ones are cut into full pieces, the first of which may be shorter. The tables hold the
pieces; what the packing itself needs is only how many pieces there are of each length, at most `capacity` numbers. Best-fit
decreasing runs on those counts: lengths in falling order, each piece into the open bin with the least room that still takes it,
found in a segment tree over remaining capacities. Pieces of one length that follow each other into the same kind of bin are placed
as one record (first rank, bins, pieces a bin, offset), so the plan has a few thousand records however many pieces there are, and it
is the very packing that placing the pieces one by one gives. Each piece then finds its bin by its rank among the pieces of its
length; ranks are counted in salted parts, so that no length is gathered in one task.

Null texts are empty: one end id. Null ids stay null. Repeated rows are packed like any others. Empty tables give no rows. Texts of
any length are tokenised whole. Of bins with equal room the one filled last is taken; which of the pieces of one length goes where is
of no account. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, rows_of, table

CAPACITY, END = 2048, 0
#: Parts in which the pieces of a length are ranked, at most; records of a plan that are sent to every task (about 50 bytes each).
SALTS, RECORDS = 1024, 200_000
VOCABULARY = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}


class TightestFit:
    """A segment tree over remaining capacities 0..capacity: how many open bins have each; the least room of at least s in O(log capacity)."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, room: int, bins: int) -> None:
        at = room + self.size
        while at:
            self.tree[at] += bins
            at >>= 1

    def find(self, least: int) -> int | None:
        at = least + self.size
        if self.tree[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:  # the right neighbour's subtree has the next larger rooms
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Records (length, first rank, pieces, first bin, pieces a bin, offset in the bin)."""
    tree, open_bins, plan, new = TightestFit(capacity), {}, [], 0
    for size in sorted((s for s in counts if counts[s]), reverse=True):
        rank, left = 0, counts[size]
        while left:
            room = tree.find(size)
            if room is None:
                room, first, bins = capacity, new, -(-left // (capacity // size))
                new += bins
            else:
                first, bins = open_bins[room].pop()
                tree.add(room, -bins)
            each = room // size  # the bin just used has less room, so it stays the tightest until it is full for this length
            full = min(bins, left // each)
            if full:
                plan.append((size, rank, full * each, first, each, capacity - room))
                rank, left = rank + full * each, left - full * each
                _put(tree, open_bins, room - each * size, first, full)
            if full < bins:
                if left:
                    plan.append((size, rank, left, first + full, left, capacity - room))
                    _put(tree, open_bins, room - left * size, first + full, 1)
                    full, left = full + 1, 0
                _put(tree, open_bins, room, first + full, bins - full)
    return plan


def _put(tree: TightestFit, open_bins: dict, room: int, first: int, bins: int) -> None:
    if room and bins:
        open_bins.setdefault(room, []).append((first, bins))
        tree.add(room, bins)


@lru_cache(maxsize=2)
def _encoder(path: str):
    import base64

    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def token_ids(encoder, text: str) -> list[int]:
    """The ids of a text. The library's own splitting gives up on runs of about a million blanks; the pieces of such a text are found
    here, with the pattern and the special tokens that it uses, and encoded one by one by the library."""
    try:
        return encoder.encode(text, allowed_special="all")
    except ValueError:
        import regex
        from public_tokenizers import PATTERN

        pieces, out, marks = regex.compile(PATTERN), [], "|".join(map(regex.escape, SPECIAL))
        for part in regex.split(f"({marks})", text):
            if part in SPECIAL:
                out.append(SPECIAL[part])
            else:
                for m in pieces.finditer(part):
                    out += encoder._encode_single_piece(m.group())
        return out


def _pieces(capacity: int, end: int, vocabulary: str | None):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encoder = _encoder(vocabulary or public_tokenizers.path(VOCABULARY))
        for batch in rows_of(batches):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array([*token_ids(encoder, text or ""), end], "<u4")
                cuts = [0, *range(len(ids) % capacity or min(capacity, len(ids)), len(ids) + 1, capacity)]
                out += [(doc_id, k, i, j - i, zlib.crc32(ids[i:j].tobytes())) for k, (i, j) in enumerate(zip(cuts, cuts[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset. vocabulary: a tiktoken file's path on the executors."""
    spark = docs.sparkSession
    salts = min(SALTS, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = cut(texts.mapInArrow(_pieces(capacity, end, vocabulary), "doc_id long, piece int, start long, length long, ids_crc32 long").withColumn("uid", F.monotonically_increasing_id()))
    # by a number of its own, so that equal pieces spread as well
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)))
    parts = cut(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator()}  # at most `capacity` rows
    records = best_fit_decreasing(counts, capacity) or [(0, 0, 0, 0, 1, 0)]
    plan = spark.createDataFrame(records, "size long, first long, pieces long, bin long, each long, at long")
    before = F.expr("sum(n) over (partition by length order by salt rows between unbounded preceding and 1 preceding)")
    parts = parts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.withColumn("nth", F.expr("row_number() over (partition by length, salt order by uid)"))
    # both sides are dealt by length and salt already
    ranked = ranked.join(parts.hint("merge"), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("nth") - 1)
    # the plan has a few records for each of at most `capacity` lengths, whatever the input; a larger one is not broadcast
    placed = ranked.join(F.broadcast(plan) if len(records) <= RECORDS else plan.hint("merge"), (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("pieces")))
    return placed.select(
        F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("bin") + F.floor((F.col("rank") - F.col("first")) / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(F.col("rank") - F.col("first"), F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
