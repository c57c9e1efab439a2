import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.llm import toxicity as T

BAD = {"en": ["idiot", "moron", "scum"], "xx": ["lowei", "achli"]}


def corpus(n, seed):
    r = random.Random(seed)
    letters = "etaoinshrdlu"
    words = ["".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(1500)]
    r = random.Random(seed + 1)
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.choice([20, 80, 80, 400, 3000]))]
        toxic = r.random() < 0.2
        low = r.random() < 0.2
        if toxic:
            for _ in range(3):
                bad = r.choice(BAD["en"]) if i % 2 else r.choice(BAD["xx"]) + "".join(r.choice(letters) for _ in range(3))
                w.insert(r.randrange(len(w)), bad)
        if low:
            w = [x + "###" if r.random() < 0.3 else x for x in w]
        docs.append((i, " ".join(w), "x"))
        labels.append((i, int(not low), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus(1200, 3)
    d = spark.createDataFrame(docs, "doc_id long, text string, toxic string")
    y = spark.createDataFrame([x for x in labels if x[0] < 900] + [(5, 1, 0), (10**6, 1, 1), (None, 1, 1), (7, None, 1)], "doc_id long, quality int, toxic int")
    return d, labels, T.train(d, y)


def test_held_out_accuracy(fitted):
    d, labels, chain = fitted
    got = {r["doc_id"]: r["toxic"] for r in T.classify(d, chain).collect()}
    held = [x for x in labels if x[0] >= 900]
    assert np.mean([got[i] == bool(t) for i, _, t in held]) > 0.97
    assert np.mean([got[i] for i, _, t in held if not t]) < 0.01


def test_later_models_see_earlier_predictions(fitted):
    _, _, chain = fitted
    assert chain.order == ("low_quality", "severe", "toxic")
    assert [len(m.d) for m in chain.models] == [0, 1, 2]
    assert chain.models[2].d[1] != 0
    assert chain.out_of_fold.shape[1] == 3


def test_chain_against_a_plain_one_in_the_driver(spark):
    """Brute force: the same fits one after the other, on rows held here."""
    r = random.Random(8)
    found = [np.unique([i % 7, 20 + i % 3, *(r.randrange(30, 40) for _ in range(4))]).astype(np.int32) for i in range(100)]
    flags = {"a": np.arange(100) % 7 < 3, "b": np.arange(100) % 3 == 0}
    sample = spark.createDataFrame([(i, bytes(found[i].tobytes()), int(flags["a"][i]), int(flags["b"][i])) for i in range(100)], "id long, found binary, is_a int, is_b int")
    chain = T.fit_chain(sample, ("a", "b"))
    fold, rows, dense = T.fold_of(np.arange(100)), T.Rows(found), np.zeros((100, 0))
    assert set(fold) == set(range(T.FOLDS)) and chain.ids.tolist() == list(range(100))
    for k, name in enumerate(("a", "b")):
        out = np.zeros(100)
        for f in range(T.FOLDS):
            out[fold == f] = T.Linear(rows, dense, flags[name], fold != f).predict(rows, dense)[fold == f]
        whole = T.Linear(rows, dense, flags[name], np.ones(100, bool))
        assert np.allclose(chain.out_of_fold[:, k], out) and np.allclose(chain.models[k].w, whole.w) and chain.models[k].at.tolist() == whole.at.tolist()
        dense = np.column_stack([dense, out])


def test_words_of_any_length_and_script(spark, fitted):
    assert len(T.features("あ" * 5000)) and len(T.features("x" * 100_000))
    joined = T.features("\u00a0".join(["quite", "idiot", "words"] * 20))
    assert set(T.features("idiot").tolist()) <= set(joined.tolist())
    assert set(T.features("idiot").tolist()) <= set(T.features("_".join(["quite", "idiot", "words"] * 20)).tolist())
    d, _, chain = fitted
    text = "\u00a0".join(["idiot", "moron", "scum", "tea", "sun"] * 9)
    assert T.classify(spark.createDataFrame([(1, text)], "doc_id long, text string"), chain).first()["toxic"]


def test_ids_repeated_with_different_texts(spark):
    docs, labels = corpus(200, 5)
    d = spark.createDataFrame(docs + [(i, "sun tea " + t, x) for i, t, x in docs[:100]], "doc_id long, text string, toxic string")
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    a, b = T.train(d, y), T.train(d.orderBy(F.desc("text")).repartition(3), y)
    assert a.ids.tolist() == b.ids.tolist() and np.allclose(a.out_of_fold, b.out_of_fold)


def test_bound_and_odd_rows(spark, fitted):
    d, labels, chain = fitted
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert len(T.train(d, y, most=50).out_of_fold) == 50
    odd = spark.createDataFrame([(None, None, "x"), (1, "", "x"), (2, "idiot moron scum", "x"), (2, "idiot moron scum", "x"), (3, "e" * 100_000, "x")], "doc_id long, text string, toxic string")
    assert sorted([(r["doc_id"], r["toxic"]) for r in T.classify(odd, chain).collect()], key=str) == [(1, False), (2, True), (2, True), (3, False), (None, False)]
    kept = T.drop_toxic(odd, chain)
    assert kept.schema == odd.schema and sorted(map(tuple, kept.collect()), key=str)[0][0] == 1 and kept.count() == 3
    assert T.classify(odd.limit(0), chain).count() == 0


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "a b c", "x")], "doc_id long, text string, toxic string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["toxic"] for r in T.classify(d, T.train(d, none)).collect()] == [False]
