import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.llm import anchors, suffix_sort
from tidebar.llm.substring_dedup import remove_repeated_passages
from tidebar.llm.suffix_dedup import remove_repeated_bytes

SCHEMA = "doc_id long, text string, cover string, h int"


def cover(sequences, w):
    """Brute force: positions covered by a window that starts in two places or more."""
    n = Counter(tuple(s[i : i + w]) for s in sequences for i in range(len(s) - w + 1))
    out = []
    for s in sequences:
        gone = np.zeros(len(s), bool)
        for i in range(len(s) - w + 1):
            if n[tuple(s[i : i + w])] > 1:
                gone[i : i + w] = True
        out.append(gone)
    return out


def corpus(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(400)]
    make = lambda n: [r.choice(words) for _ in range(n)]
    shared = [make(r.randint(20, 200)) for _ in range(6)]
    texts = []
    for _ in range(40):
        t = make(r.randint(0, 150))
        for _ in range(r.randint(0, 3)):
            s = list(r.choice(shared))
            if r.random() < 0.5:
                s[r.randrange(len(s))] = "x"
            t += s[r.randint(0, 8) :] + make(r.randint(0, 60))
        texts.append(" ".join(t))
    texts += [texts[0], texts[1], "", None, "a " * 300, "a" * 900, "b" * 401, "\n\t ", "short"]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, texts[2], "c", 2), (None, None, None, None)]


def test_anchors_own_every_window_once():
    x = np.random.default_rng(1).integers(0, 3, 3000)
    seen = []
    where = np.array([0, 0, 700, 740, 3000])
    for seq, h, pos, lo, hi in anchors.anchors(x, where, 50, 5):
        for q, p, a, b in zip(seq, pos, lo, hi):
            assert b <= p and p + 5 <= a + 50 and where[q] <= a and b + 50 <= where[q + 1]
            seen += range(a, b + 1)
    assert seen == [*range(651), *range(740, 2951)]


def test_gram_hashes_are_by_content():
    x = np.array([1, 2, 3, 4, 5, 6, 1, 2, 3, 4, 5, 6], np.uint64)
    for k in (1, 2, 3, 5, 6):
        h = anchors.gram_hashes(x, k)
        assert len(h) == len(x) - k + 1 and h[0] == h[6] and len(set(h.tolist())) == 6
    assert len(anchors.gram_hashes(x[:3], 5)) == 0


def test_merge_sort_orders_suffixes():
    r = random.Random(3)
    data = bytes(r.choice(b"ab") for _ in range(400))
    block = suffix_sort.HashedBlock(data)
    places, group = np.arange(300), np.repeat([0, 1, 2], [10, 200, 90])
    order = suffix_sort.merge_sort(block, places, group, 50)
    want = sorted(range(300), key=lambda i: (group[i], data[i : i + 50], i))
    assert order.tolist() == want


def test_hash_collisions_are_caught(monkeypatch):
    monkeypatch.setattr(suffix_sort, "BASE", np.uint64(1))  # sums of bytes: collisions everywhere
    data = b"abcdbadcabcd"
    flag = suffix_sort.repeated(data, np.array([0, 4, 8]), np.zeros(3, int), np.zeros(3, int), np.ones(3, int), 4)
    assert flag.tolist() == [True, False, True]


@pytest.mark.parametrize("hot", [256, 1])
def test_repeated_bytes_against_brute_force(spark, hot):
    rows = corpus(5)
    got = sorted(map(tuple, remove_repeated_bytes(spark.createDataFrame(rows, SCHEMA), window=60, gram=8, hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)
    data = [(t or "").encode() for _, t, *_ in rows]
    want = []
    for (i, *_), d, gone in zip(rows, data, cover(data, 60)):
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        want.append((i, len(d), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) > 0).sum()), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want, key=str)
    assert sum(x[2] for x in want) > 5000


@pytest.mark.parametrize("hot", [256, 1])
def test_repeated_passages_against_brute_force(spark, hot):
    rows = corpus(6)
    got = sorted(map(tuple, remove_repeated_passages(spark.createDataFrame(rows, SCHEMA), window=12, hot=hot).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)
    seqs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    want = [(i, len(s), int(g.sum()), hashlib.sha256(" ".join(w for w, x in zip(s, g) if not x).encode()).hexdigest()) for (i, *_), s, g in zip(rows, seqs, cover(seqs, 12))]
    assert got == sorted(want, key=str)


def test_word_hash_collisions_are_caught(monkeypatch):
    from tidebar.llm import substring_dedup as S

    monkeypatch.setattr(S.A, "gram_hashes", lambda h, k: np.zeros(max(0, len(h) - k + 1), np.uint64))
    rows = [{"data": x.encode()} for x in ("a b c d e", "x b c d e", "a b c d f", "a b c q e")]
    flag = S._count(3)(rows, np.zeros(4, int), np.full(4, 2), np.full(4, 3))
    assert flag.tolist() == [True, True, True, False, True, True, True, True, False, True, False, False]


def test_a_small_sketch_loses_nothing(spark, monkeypatch):
    from tidebar.llm import substring_dedup as S

    monkeypatch.setattr(S, "width_for", lambda n: S.LEAST)
    rows = corpus(7)
    d = spark.createDataFrame(rows, SCHEMA)
    key = lambda df: sorted(map(tuple, df.select("doc_id", "n_removed", "kept_sha256").collect()), key=str)
    got = key(remove_repeated_passages(d, window=12))
    monkeypatch.setattr(S, "count_min", lambda *a: np.full(S.DEPTH * S.LEAST // 8, 255, np.uint8))
    assert got == key(remove_repeated_passages(d, window=12))
    assert [S.width_for(n) for n in (0,)] == [S.LEAST]


def test_width_of_the_sketch_is_bounded():
    from tidebar.llm import substring_dedup as S

    assert S.width_for(0) == S.LEAST and S.width_for(10**15) == S.WIDEST
    assert 2 * 840_000_000 // S.PER_ANCHOR <= S.width_for(840_000_000) < 4 * 840_000_000 // S.PER_ANCHOR + 2


def test_long_texts_cross_chunks(spark, monkeypatch):
    """Texts over the chunk of window starts (made small here) and one over a megabyte."""
    monkeypatch.setattr(anchors, "CHUNK", 256)
    r = random.Random(4)
    words = ["".join(r.choice("abcde") for _ in range(r.randint(1, 7))) for _ in range(300)]
    passage = " ".join(r.choice(words) for _ in range(150))
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    texts = [make(300) + " " + passage + " " + make(250), passage + " " + make(700), make(40) + " " + passage]
    data = [t.encode() for t in texts]
    for d, gone in zip(data, cover(data, 60)):  # anchors of all chunks together own every window once
        seen = [x for *_, lo, hi in anchors.anchors(np.frombuffer(d, np.uint8), np.array([0, len(d)]), 60, 8) for a, b in zip(lo, hi) for x in range(a, b + 1)]
        assert seen == list(range(len(d) - 59)) and gone.any()


def test_a_text_over_a_megabyte(spark):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(5000)]
    body = [r.choice(words) for _ in range(230_000)]
    text = " ".join(body)
    passage = " ".join(body[190_000:190_200])  # beyond the first 2^20 window starts
    assert len(text) > 1.2e6 and text.index(passage) > 2**20
    d = spark.createDataFrame([(1, text), (2, "other words first " + passage)], "doc_id long, text string")
    got = {x["doc_id"]: x["n_removed"] for x in remove_repeated_bytes(d).collect()}
    assert got[1] == got[2] and len(passage) <= got[1] <= len(passage) + 2
    got = {x["doc_id"]: x["n_removed"] for x in remove_repeated_passages(d).collect()}
    assert got == {1: 200, 2: 200}


def test_many_rows_without_an_id(spark):
    """Null ids are told apart by a 64-bit hash of their text: on 70,000 different texts no one gets another's cuts."""
    d = spark.range(70_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", *(F.hex(F.xxhash64("id", F.lit(k))) for k in range(4))).alias("text"))
    twice = d.limit(1).select("doc_id", F.concat_ws(" ", F.col("text"), F.col("text")).alias("text")).select("doc_id", F.repeat(F.concat(F.col("text"), F.lit(" ")), 8).alias("text"))
    got = remove_repeated_passages(d.unionByName(twice), window=12).groupBy((F.col("n_removed") > 0).alias("cut")).count().collect()
    assert {x["cut"]: x["count"] for x in got} == {False: 70_000, True: 1}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert remove_repeated_bytes(empty).count() == 0
    assert remove_repeated_passages(empty).count() == 0


def test_every_id_is_an_id(spark):
    """Both ends of 64 bits beside rows without an id, some with one text."""
    r = random.Random(8)
    passage = "".join(r.choice("abcdefgh ") for _ in range(900)) + " " + " ".join(f"word{i}" for i in range(50))
    ids = [-(2**63), 2**62, 2**63 - 1, None]
    rows = [(i, f"{k} " + passage if k % 2 else f"{k} alone") for k, i in enumerate(ids * 2)] + [(i, "one text") for i in ids]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for found, key in ((remove_repeated_bytes(df), "n_removed"), (remove_repeated_passages(df), "n_removed")):
        got = sorted(((x["doc_id"], x[key] > 0) for x in found.collect()), key=str)
        assert got == sorted(((i, "alone" not in t and t != "one text") for i, t in rows), key=str)
