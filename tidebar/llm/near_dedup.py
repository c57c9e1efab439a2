"""Near duplicates by ProbMinHash, banding and verification.

Two documents are linked when the Jaccard similarity of their sets of five-word shingles is 0.8 or more; classes are the connected
components of the links. ProbMinHash: each shingle is a Poisson process whose rate is its weight; its arrivals, drawn from its hash,
fall on random registers, a register keeps the earliest, and a shingle's process ends as soon as its next arrival is later than every
register (early termination). Two signatures agree in a register with the probability Jaccard similarity. Here all shingles weigh the
same, whatever their occurrences: then that is the Jaccard similarity of the sets, by which links are decided. Bands of registers
give candidates, whose texts then decide: every link is verified on the shingles.

Copies (equal word sequences) are one node, its smallest id. In a bucket, all members are compared with the one that meets most
others over all bands, the middle of its group. As long as it then holds several classes, a few such members outside its largest
class (pivots) are compared with the members of other classes, then a
few more, and at last all that are still outside; only pairs that the signatures estimate at 0.68 or more (3.5 standard errors below
0.8) are verified, and documents of buckets with several classes get a second signature of 2,048 one-bit registers, whose estimate
must be 0.747 or more (4 standard errors below). So in the end every pair of a bucket is in one class, or was compared, or is
estimated far below; no pairs are made within a class.

Documents with fewer than five words have no shingles: they are in a class with their copies only, as are empty and null texts with
each other. Texts of any length are read whole. Null ids come last; of a class the row with the smallest id stays, the first of
equal ones. Rows that repeat an id are one row each in the result; texts that share an id are in one class. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, rows_of, table, text_bytes, word_hashes, word_places

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 28, 5
#: Rounds of comparing members outside a bucket's largest class with the other classes: how many of them (0: all that are left), and
#: the least similarity that signatures must estimate, with a standard error of 0.034. What is alike is joined first, so that little
#: is left for the last round, which leaves nothing out above 0.68.
ROUNDS = ((4, 0.68), (0, 0.78), (0, 0.68))
#: The second signature: longs of 64 one-bit registers, and the most that may differ. Registers differ by (1 - similarity) / 2.
LONGS = 32
DIFFER = int((1 - (SIMILAR - 4 * 2 * (0.9 * 0.1 / (64 * LONGS)) ** 0.5)) / 2 * 64 * LONGS)
_I = pa.int64()


def shingles(hashed: np.ndarray, words: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, occurrences) of the distinct shingles of each text; words: where each text's words begin (n + 1 places)."""
    from .anchors import gram_hashes

    h = gram_hashes(hashed, k)
    size = np.diff(words)
    text = np.repeat(np.arange(len(size)), np.maximum(size - k + 1, 0))
    at = np.arange(len(text)) - np.repeat(np.cumsum(np.maximum(size - k + 1, 0)) - np.maximum(size - k + 1, 0), np.maximum(size - k + 1, 0)) + words[text]
    h = h[at] if len(at) else np.empty(0, np.uint64)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    head = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.empty(0, np.int64)
    return text[head], h[head], np.diff(np.concatenate([head, [len(h)]]))


def _draw(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-th gap and register of each shingle's process, from its hash alone."""
    with np.errstate(over="ignore"):
        x = mix(h + np.uint64((0x9E3779B97F4A7C15 * (2 * n + 1)) % 2**64))
        y = mix(h + np.uint64((0x9E3779B97F4A7C15 * (2 * n + 2)) % 2**64))
    return -np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53), (y >> np.uint64(32)).astype(np.int64)


def prob_min_hash(text: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int, m: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (texts x m) of weighted shingles; 0 where a text has none."""
    best, who = np.full(texts * m, np.inf), np.zeros(texts * m, np.uint64)
    now, n = np.zeros(len(h)), 0
    has = np.zeros(texts, bool)
    has[text] = True
    while len(h):
        gap, register = _draw(h, n)
        now = now + gap / weight
        at = text * m + register % m
        order = np.lexsort((now, at))
        first = order[np.concatenate([[True], at[order][1:] != at[order][:-1]])]
        first = first[now[first] < best[at[first]]]
        best[at[first]], who[at[first]] = now[first], h[first]
        latest = best.reshape(texts, m).max(axis=1)
        alive = now < latest[text]
        text, h, weight, now = text[alive], h[alive], weight[alive], now[alive]
        n += 1
    out = who.reshape(texts, m)
    out[~has] = 0
    return out


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The second signature of each text: the lowest bit of each of its registers."""
    for batch in rows_of(batches):
        data, where = text_bytes(batch.column("text"))
        begin, end, words = word_places(data, where)
        text, h, _ = shingles(word_hashes(data, begin, end), words)
        who = prob_min_hash(text, mix(h), np.ones(len(h)), batch.num_rows, 64 * LONGS)
        bits = np.packbits((mix(who) & np.uint64(1)).astype(np.uint8), axis=1).view("<i8").reshape(-1, LONGS)
        flat = pa.array(bits.ravel(), _I)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, LONGS), pa.int32()), flat)], names=["id", "bits"])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    schema = pa.schema([("kid", _I), ("h", _I), ("w1", _I), ("w2", _I), ("sig", pa.binary())])
    for batch in rows_of(batches):
        data, where = text_bytes(batch.column("text"))
        begin, end, words = word_places(data, where)
        hashed = word_hashes(data, begin, end)
        text, h, _ = shingles(hashed, words)
        sig = (prob_min_hash(text, h, np.ones(len(h)), batch.num_rows) & np.uint64(0xFFFFFFFF)).astype("<u4")
        full = np.zeros(batch.num_rows, bool)
        full[text] = True
        out = []
        for i, (kid, th) in enumerate(zip(batch.column("kid").to_pylist(), batch.column("h").to_pylist())):
            # equal words: the words themselves, joined by one space
            same = xxhash.xxh3_128_digest(b" ".join(data[where[i] : where[i + 1]].tobytes().split()))
            w1, w2 = np.frombuffer(same, np.int64).tolist()
            out.append((kid, th, w1, w2, sig[i].tobytes() if full[i] else None))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _verify(similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", _I), ("b", _I)])
        for batch in rows_of(batches):
            sets = []
            for side in ("ta", "tb"):
                data, where = text_bytes(batch.column(side))
                begin, end, words = word_places(data, where)
                text, h, _ = shingles(word_hashes(data, begin, end), words)
                sets.append((h, np.searchsorted(text, np.arange(batch.num_rows + 1))))
            (ha, wa), (hb, wb) = sets
            ok = []
            for i in range(batch.num_rows):
                x, y = ha[wa[i] : wa[i + 1]], hb[wb[i] : wb[i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similar * (len(x) + len(y) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=schema).filter(pa.array(ok))

    return run


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class) of all nodes: the smallest id reachable over links (a, b), by alternating large and small stars until nothing moves."""
    pair = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    edges = cut(pair(links))
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        down = cut(pair(both.where("b > a").join(least, "a").select("b", "m").toDF("a", "b")))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        edges = cut(pair(down.join(least, "a").where("b != m").select("b", "m").toDF("a", "b").unionByName(least.toDF("a", "b"))))
        now = state(edges)
        if now == before:
            break
        before = now
    return nodes.join(edges.select(F.col("a").alias("id"), F.col("b").alias("_to")), "id", "left").select("id", F.coalesce("_to", "id").alias("class"))


def _links(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    a, b = (texts.select(F.col("id").alias(x), F.col("text").alias("t" + x)) for x in ("a", "b"))
    return cut(pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb").mapInArrow(_verify(similar), "a long, b long"))


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _node_id(id_col: str, text_col: str) -> Column:
    """A row's id, or its text's hash where it has none; `_hash` tells the two apart. (Such a hash is some row's id with a probability
    of 2^-64 a pair; the two would then be of one class.)"""
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(_text(text_col)))


def _hash(id_col: str, text_col: str) -> Column:
    """63 bits of the text's hash, and as the lowest bit whether the row has no id."""
    return F.xxhash64(_text(text_col)).bitwiseAND(F.lit(-2)).bitwiseOR(F.col(id_col).cast("long").isNull().cast("long"))


_LESS = "struct(h & 1 as nul, kid, rid)"


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """(kid, h, rid, class, class_size, least): for each row its node, its text's hash with the null flag, its number, its class with
    the number of rows there, and flag, node and number of the row that stays."""
    texts = docs.select(_node_id(id_col, text_col).alias("kid"), _hash(id_col, text_col).alias("h"), _text(text_col).alias("text"))
    sigs = cut(texts.select("kid", "h", "text").mapInArrow(_signatures, "kid long, h long, w1 long, w2 long, sig binary").withColumn("rid", F.monotonically_increasing_id()))
    same = cut(sigs.groupBy("w1", "w2").agg(F.min("kid").alias("id"), F.any_value("sig").alias("sig")))
    # several texts may share an id (rows that repeat it): their classes are one
    nodes = same.select("id").distinct()
    bands = F.expr(f"transform(sequence(0, {BANDS - 1}), i -> struct(i as band, xxhash64(i, substring(sig, i * {4 * ROWS} + 1, {4 * ROWS})) as hash))")
    member = same.where("sig is not null").select("id", F.explode(bands).alias("x")).select("id", "x.band", "x.hash")
    bucket = cut(member.groupBy("band", "hash").agg(F.count("*").alias("n")).where("n > 1"))
    member = cut(member.join(bucket, ["band", "hash"]))
    # the member that meets most others over all bands stands nearest to the middle of its group
    member = cut(member.join(cut(member.groupBy("id").agg(F.sum("n").alias("met"))), "id").select("band", "hash", "id", "met"))
    head = cut(member.groupBy("band", "hash").agg(F.max_by("id", F.struct("met", -F.col("id"))).alias("head")))
    pairs = cut(member.join(head, ["band", "hash"]).where("id != head").select(F.least("head", "id").alias("a"), F.greatest("head", "id").alias("b")).distinct())
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    # the same plan at every size: texts and wanted ids meet by hash
    wanted = wanted.hint("merge")
    # the texts of each node that is in a pair (several, where they share an id); every later pair is between such nodes
    sample = texts.select(F.col("kid").alias("id"), "text").join(wanted, "id", "left_semi").groupBy("id", F.xxhash64("text").alias("_h")).agg(F.min("text").alias("text")).drop("_h")
    sample = cut(sample)
    cls, done = cut(components(nodes, _links(pairs, sample, similar))), pairs
    sigs_of = cut(same.where("sig is not null").select("id", "sig").join(sample.select("id"), "id", "left_semi").distinct())
    open_, bits = member, None
    first = "case " + " ".join(f"when substring(sx, {4 * ROWS * i + 1}, {4 * ROWS}) = substring(sy, {4 * ROWS * i + 1}, {4 * ROWS}) then {i}" for i in range(BANDS)) + " end"
    agree = " + ".join(f"cast(substring(sx, {4 * i + 1}, 4) = substring(sy, {4 * i + 1}, 4) as int)" for i in range(BANDS * ROWS))
    differ = " + ".join(f"bit_count(bx[{i}] ^ by[{i}])" for i in range(LONGS))
    most_differ = DIFFER if similar == SIMILAR else int((1 - (similar - 4 * 2 * ((1 + similar) * (1 - similar) / 4 / (64 * LONGS)) ** 0.5)) / 2 * 64 * LONGS)
    for pivots, least in ROUNDS:
        # what is left: buckets of several classes, all their members
        open_ = open_.select("band", "hash", "id", "met").join(cls, "id")
        parts = open_.groupBy("band", "hash", "class").agg(F.count("*").alias("n"))
        most = cut(parts.groupBy("band", "hash").agg(F.max_by("class", F.struct("n", "class")).alias("main"), F.count("*").alias("classes")).where("classes > 1"))
        open_ = cut(open_.join(most, ["band", "hash"]))
        if open_.isEmpty():
            break
        if bits is None:  # later rounds have no other documents than the first
            bits = cut(sample.join(open_.select("id").distinct(), "id", "left_semi").mapInArrow(_bits, "id long, bits array<long>"))
        open_ = cut(open_.join(sigs_of, "id").join(bits, "id"))
        other = open_.where("class != main").select("band", "hash", "met", F.col("id").alias("x"), F.col("class").alias("cx"), F.col("sig").alias("sx"), F.col("bits").alias("bx"))
        if pivots:
            other = other.groupBy("band", "hash", F.pmod(F.xxhash64("x"), F.lit(pivots)).alias("_")).agg(F.max_by(F.struct("x", "cx", "sx", "bx"), F.struct("met", -F.col("x"))).alias("p")).select("band", "hash", "p.*")
        other = cut(other)
        rest = open_.select("band", "hash", F.col("id").alias("y"), F.col("class").alias("cy"), F.col("sig").alias("sy"), F.col("bits").alias("by"))
        near = other.join(rest, ["band", "hash"]).where(f"cx != cy and ({differ}) <= {most_differ} and {first} = band and ({agree}) >= {int(least * BANDS * ROWS)}").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        fresh = cut(near.join(done, ["a", "b"], "left_anti"))
        done = done.unionByName(fresh)
        links = _links(fresh, sample, similar)
        # the new links join classes, and only those are looked at
        merged = links.join(cls.select(F.col("id").alias("a"), F.col("class").alias("ca")), "a").join(cls.select(F.col("id").alias("b"), F.col("class").alias("cb")), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        merged = cut(merged.where("a != b").distinct())
        if not merged.isEmpty():
            ids = merged.select(F.col("a").alias("id")).unionByName(merged.select(F.col("b").alias("id"))).distinct()
            moved = components(ids, merged).select(F.col("id").alias("class"), F.col("class").alias("_to"))
            cls = cut(cls.join(moved, "class", "left").select("id", F.coalesce("_to", "class").alias("class")))
    rows = cut(sigs.select("kid", "h", "rid", "w1", "w2").join(same.select("w1", "w2", "id"), ["w1", "w2"]).join(cls, "id").select("kid", "h", "rid", "class"))
    size = cut(rows.groupBy("class").agg(F.count("*").alias("class_size"), F.min(F.expr(_LESS)).alias("least")))
    return rows.join(size, "class")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row per document: id, class_id (the smallest id of its class), class_size, kept (it is that document)."""
    ids = F.expr("if(h & 1 = 0, kid, null)").alias(id_col), F.expr("if(least.nul = 0, least.kid, null)").alias("class_id")
    return decide(docs, id_col, text_col, similar).select(*ids, "class_size", (F.expr(_LESS) == F.col("least")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One document of each class, the one with the smallest id, with all columns; of equal rows that repeat that id one stays."""
    found = decide(docs, id_col, text_col, similar).where("kid = least.kid and h & 1 = least.nul")
    stay = found.groupBy("kid", "h").agg(F.count("*").alias("_m"), F.max(F.expr(_LESS) == F.col("least")).alias("_it")).where("_it")
    rows = docs.withColumns({"_node": _node_id(id_col, text_col), "_hash": _hash(id_col, text_col)}).join(stay.select(F.col("kid").alias("_node"), F.col("h").alias("_hash"), "_m"), ["_node", "_hash"])
    return rows.where("_m = 1").select(docs.columns).unionByName(rows.where("_m > 1").dropDuplicates(["_node", "_hash"]).select(docs.columns))


def op3_prob_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
