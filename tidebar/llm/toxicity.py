"""Toxicity by a chain of linear classifiers.

The categories of CHAIN are predicted one after the other. Each is a logistic regression over the presence of hashed words and word
beginnings, chosen by their association with the category in the training rows; the models after the first also see the
probabilities of the categories before them. In training these are out-of-fold predictions (FOLDS folds by id), so a later model
learns from probabilities as good as it will meet, not from ones fitted to the very rows.

The table of labels has a quality flag and a toxic flag. The chain is `low_quality` (quality 0), `severe` (toxic, and among the
toxic training rows at or above the median number of words that only toxic rows have), `toxic` (the flag); a document is rejected
where the last is REJECT or more. Models are fitted on at most TRAIN_ROWS labelled rows, those with the smallest hash of their id; a
row labelled twice counts once, rows without a label or a text are not used; of several texts with one labelled id the one with the
smallest hash is taken. With no labelled row of either class a category's probability is its share in training, 0 without labels.

The driver holds no training rows: features are made where the texts are, written once as a table, and every fit (one of the whole
sample and one for each fold, for each category) is a task of its own; weights and out-of-fold probabilities come back.

Null and empty texts have no features; their probabilities come from the intercepts and toxic is false for them. Texts are read
whole, words of any length and script: words end at any Unicode white space, long runs without any are taken by their letters' parts
and those, where still long, by all their three-letter strings. Counts do not matter, only presence, so a long text is not diluted.
Repeated rows and rows that repeat an id get results by their own texts. An empty table gives an empty result. Extra columns are
ignored by `classify` and carried by `drop_toxic`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, rows_of, table

CHAIN = ("low_quality", "severe", "toxic")
TRAIN_ROWS = 10_000
FOLDS = 5
BITS = 20
#: A model has at most so many features, each at least TELLING times as frequent in one class as in the other.
CHOSEN, TELLING = 3_000, 2.5
#: The probability of the last category from which a document is rejected; held-out clean documents stay below a tenth of it.
REJECT = 0.1
#: Lengths in letters of the word beginnings that are features beside whole words.
BEGINNINGS = (3, 4, 5, 6)


#: Words of more letters are taken apart.
LONG = 32


def _keys(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:n] for n in BEGINNINGS if len(word) >= n)]


@lru_cache(maxsize=60_000)
def _word_features(word: str) -> tuple[int, ...]:
    return tuple(_hashed(word))


def _hashed(word: str) -> set[int]:
    import xxhash

    w = word.lower().strip(".,;:!?\"'()[]{}<>|*#%$&-")
    keys = _keys(w) if w else []
    if len(w) > LONG:  # no white space for long: scripts without it, or words joined by signs
        for part in set(re.findall(r"[^\W_]+", w)):
            keys += _keys(part)
            if len(part) > LONG or not part.isascii():
                keys += {"~" + part[i : i + 3] for i in range(len(part) - 2)} | {"~" + part[i : i + 2] for i in range(len(part) - 1)}
    return {xxhash.xxh3_64_intdigest(k.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for k in keys}


def features(text: str | None) -> np.ndarray:
    found: set[int] = set()
    for w in set((text or "").split()):
        found.update(_word_features(w) if len(w) <= LONG else _hashed(w))
    return np.sort(np.fromiter(found, np.int32, len(found)))


class Rows:
    """Sparse rows of present features."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.col = np.concatenate(rows) if rows else np.empty(0, np.int32)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def counts(self, keep: np.ndarray) -> np.ndarray:
        return np.bincount(self.col[keep[self.row]], minlength=1 << BITS)


class Linear:
    """Logistic regression on chosen features and some dense columns, by accelerated gradient steps."""

    def __init__(self, rows: Rows, dense: np.ndarray, y: np.ndarray, fit: np.ndarray, l2: float = 1e-4, steps: int = 150):
        self.at, self.w, self.d, self.b = np.empty(0, np.int64), np.empty(0, np.float32), np.zeros(dense.shape[1]), 0.0
        pos, neg = int((y & fit).sum()), int((~y & fit).sum())
        if not pos or not neg:
            self.b = -30.0 if not pos else 30.0
            return
        p, q = rows.counts(y & fit), rows.counts(~y & fit)
        rate, other = (p + 0.5) / (pos + 1), (q + 0.5) / (neg + 1)
        telling = (p + q >= 3) & (np.maximum(rate, other) >= TELLING * np.minimum(rate, other))
        gain = np.where(telling, (p + q) * (rate - other) ** 2 / (rate + other), 0.0)
        chosen = np.argsort(-gain, kind="stable")[:CHOSEN]
        new = np.full(1 << BITS, -1)
        new[chosen[gain[chosen] > 0]] = np.arange(int((gain[chosen] > 0).sum()))
        used = np.flatnonzero((new[rows.col] >= 0) & fit[rows.row])
        row, col = np.searchsorted(np.flatnonzero(fit), rows.row[used]), new[rows.col[used]]
        n, k = int(fit.sum()), int(new.max()) + 1
        t, x = y[fit].astype(float), dense[fit]
        weight = np.where(t > 0, 0.5 / pos, 0.5 / neg)
        w, d, b = np.zeros(k), np.zeros(x.shape[1]), 0.0
        old, m = (w, d, b), 0.0
        scale = 1 / (1 + np.sqrt(np.bincount(col, weight[row], k)))
        for step in range(steps):
            m = step / (step + 3)
            wy, dy, by = w + m * (w - old[0]), d + m * (d - old[1]), b + m * (b - old[2])
            z = np.bincount(row, wy[col], n) + x @ dy + by
            g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - t)
            old = w, d, b
            w = wy - 2.0 * scale * (np.bincount(col, g[row], k) + l2 * wy * np.bincount(col, weight[row], k))
            d, b = dy - 0.5 * (x.T @ g), by - 2.0 * g.sum()
        self.at = np.flatnonzero(new >= 0)
        self.w = w[new[self.at]].astype(np.float32)
        self.d, self.b = d, b

    @classmethod
    def of(cls, at: np.ndarray, w: np.ndarray, d: np.ndarray, b: float) -> Linear:
        """A model from its parts: weights `w` of the features `at`, of the dense columns, intercept."""
        self = cls.__new__(cls)
        self.at, self.w, self.d, self.b = at, w, d, b
        return self

    def predict(self, rows: Rows, dense: np.ndarray) -> np.ndarray:
        full = np.zeros(1 << BITS, np.float32)
        full[self.at] = self.w
        return 1 / (1 + np.exp(-np.clip(rows.times(full) + dense @ self.d + self.b, -30, 30)))


class Chain:
    """Fitted models in the order of their categories, and what training saw: ids and out-of-fold probabilities."""

    def __init__(self, models: list[Linear], order: tuple[str, ...] = CHAIN, ids: np.ndarray | None = None, out_of_fold: np.ndarray | None = None):
        self.order, self.models = order, models
        self.ids = np.empty(0, np.int64) if ids is None else ids
        self.out_of_fold = np.zeros((len(self.ids), len(order))) if out_of_fold is None else out_of_fold

    def predict(self, rows: Rows) -> np.ndarray:
        dense = np.zeros((rows.n, 0))
        for model in self.models:
            dense = np.column_stack([dense, model.predict(rows, dense)])
        return dense


def fold_of(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((np.asarray(ids, np.int64).astype(np.uint64) * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(FOLDS)).astype(np.int64)


def _sample(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, Rows, dict[str, np.ndarray]]:
    """Ids, features and flags of a whole sample, by id."""
    ids, found, flags = [], [], {}
    for batch in batches:
        ids.append(batch.column("id").to_numpy())
        found += [np.frombuffer(x, np.int32) for x in batch.column("found").to_pylist()]
        for c in batch.schema.names:
            if c.startswith("is_"):
                flags.setdefault(c[3:], []).append(batch.column(c).to_numpy() == 1)
    if not found:
        return np.empty(0, np.int64), Rows([]), {}
    every = np.concatenate(ids)
    order = np.argsort(every)
    return every[order], Rows([found[i] for i in order]), {c: np.concatenate(x)[order] for c, x in flags.items()}


_FIT = pa.schema([("fit", pa.int32()), ("at", pa.binary()), ("w", pa.binary()), ("d", pa.binary()), ("b", pa.float64()), ("ids", pa.binary()), ("p", pa.binary())])
_FIT_DDL = "fit int, at binary, w binary, d binary, b double, ids binary, p binary"


def _fit(name: str, k: int, before_ids: np.ndarray, before: np.ndarray, members: np.ndarray | None):
    """One fit: 0 to FOLDS - 1 leave a fold out and predict it, FOLDS takes all rows. members: the ids of the category, if no flag says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, flags = _sample(batches)
        if not len(ids):
            return
        dense = before[np.searchsorted(before_ids, ids)] if before.shape[1] else np.zeros((len(ids), 0))
        held = fold_of(ids) == k
        m = Linear(rows, dense, flags[name] if members is None else np.isin(ids, members), ~held)
        p = m.predict(rows, dense)[held]
        row = k, m.at.astype("<i8").tobytes(), m.w.astype("<f4").tobytes(), m.d.astype("<f8").tobytes(), float(m.b), ids[held].astype("<i8").tobytes(), p.astype("<f8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _FIT)], schema=_FIT)

    return run


def fit_chain(sample: DataFrame, order: tuple[str, ...] = CHAIN, members: dict[str, np.ndarray] | None = None) -> Chain:
    """A chain fitted on a written sample (id, found, is_<category>) of bounded size. For each category FOLDS + 1 tasks run side by
    side, each reading the sample for itself: nothing is shuffled. members: the ids of categories without a flag."""
    ids, dense, models = np.empty(0, np.int64), np.zeros((0, 0)), []
    for name in order:
        own = (members or {}).get(name)
        tasks = [sample.coalesce(1).mapInArrow(_fit(name, k, ids, dense, own), _FIT_DDL) for k in range(FOLDS + 1)]
        by = {r["fit"]: r for r in reduce(DataFrame.unionByName, tasks).collect()}  # FOLDS + 1 rows
        if not by:  # no labelled row
            return Chain([Linear.of(np.empty(0, np.int64), np.empty(0, np.float32), np.zeros(n), -30.0) for n in range(len(order))], order)
        r = by[FOLDS]
        models.append(Linear.of(np.frombuffer(r["at"], "<i8"), np.frombuffer(r["w"], "<f4"), np.frombuffer(r["d"], "<f8"), r["b"]))
        held = np.concatenate([np.frombuffer(by[k]["ids"], "<i8") for k in range(FOLDS)])
        p = np.concatenate([np.frombuffer(by[k]["p"], "<f8") for k in range(FOLDS)])
        at = np.argsort(held)
        if not models[1:]:
            ids, dense = held[at], np.zeros((len(held), 0))
        dense = np.column_stack([dense, p[at]])
    return Chain(models, order, ids, dense)


def _severity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of toxic rows that have at least the median number of words which only toxic rows have; one task, a bounded sample."""
    ids, sample, flags = _sample(batches)
    if not len(ids):
        return
    toxic = flags["toxic"]
    telling = (sample.counts(toxic) >= 3) & (sample.counts(~toxic) == 0)
    words = sample.times(telling.astype(float))
    severe = toxic & (words >= (np.median(words[toxic]) if toxic.any() else 0))
    yield pa.RecordBatch.from_arrays([pa.array(ids[severe])], names=["id"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_ROWS) -> Chain:
    """A chain fitted on at most `most` labelled rows of docs."""
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.where("id is not null and quality is not null and toxic is not null").groupBy("id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    bounded = rows.orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    found = texts.join(F.broadcast(bounded), "id").select("*", F.xxhash64("text").alias("h")).mapInArrow(_features, "id long, h long, is_low_quality int, is_toxic int, found binary")
    sample = cut(found.groupBy("id").agg(F.min_by(F.struct("found", "is_low_quality", "is_toxic"), "h").alias("r")).select("id", "r.*"))
    severe = [r["id"] for r in sample.coalesce(1).mapInArrow(_severity, "id long").collect()]  # at most `most` ids
    return fit_chain(sample, CHAIN, {"severe": np.array(severe, np.int64)})


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "h", "is_low_quality", "is_toxic", "found"]
    for batch in rows_of(batches):
        found = pa.array([features(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())
        low = pa.array((batch.column("quality").to_numpy() == 0).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), low, batch.column("toxic"), found], names=names)


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = model.value
        names = ["id", *(f"p_{c}" for c in chain.order), "toxic"]
        for batch in rows_of(batches):
            rows = Rows([features(t) for t in batch.column("text").to_pylist()])
            p = chain.predict(rows)
            some = np.bincount(rows.row, minlength=rows.n) > 0
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c) for c in p.T), pa.array((p[:, -1] >= REJECT) & some)], names=names)

    return run


def classify(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, the probability of each category, toxic."""
    model = docs.sparkSession.sparkContext.broadcast(chain)  # a few weight vectors of 2^BITS numbers
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_predict(model), f"id long, {', '.join(f'p_{c} double' for c in chain.order)}, toxic boolean").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            rows = Rows([features(t) for t in batch.column(text_col).to_pylist()])
            some = np.bincount(rows.row, minlength=rows.n) > 0
            yield batch.filter(pa.array(~((model.value.predict(rows)[:, -1] >= REJECT) & some)))

    return docs.mapInArrow(run, docs.schema)


def op6_classifier_chain(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))
