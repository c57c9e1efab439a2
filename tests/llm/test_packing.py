import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidebar.llm import packing as P


def one_by_one(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] >= s]
        if fits:
            b = min(fits, key=lambda b: bins[b])
            bins[b] -= s
        else:
            bins.append(capacity - s)
    return sorted(bins)


def test_plan_equals_placing_one_by_one():
    r = random.Random(5)
    for _ in range(60):
        capacity = r.choice([10, 64, 100])
        sizes = [r.randint(1, capacity) for _ in range(r.randint(0, 300))]
        counts = {s: sizes.count(s) for s in set(sizes)}
        used, placed = defaultdict(list), defaultdict(int)
        for size, first, n, b, each, at in P.best_fit_decreasing(counts, capacity):
            assert first == placed[size]
            placed[size] += n
            for i in range(n):
                used[b + i // each].append((at + i % each * size, size))
        assert placed == counts
        for items in used.values():
            items.sort()
            assert [a for a, _ in items] == [sum(s for _, s in items[:k]) for k in range(len(items))] and sum(s for _, s in items) <= capacity
        assert sorted(capacity - sum(s for _, s in x) for x in used.values()) == one_by_one(sizes, capacity)


def test_tightest_fit():
    t = P.TightestFit(20)
    for room in (3, 7, 20):
        t.add(room, 2)
    assert [t.find(s) for s in (1, 3, 4, 7, 8, 20)] == [3, 3, 7, 7, 20, 20]
    t.add(20, -2)
    assert t.find(8) is None


def test_pack(spark):
    r = random.Random(6)
    words = ["the", "Straße", "naïve", "  ", "\n", "<|endoftext|>", "日本", "x1y2"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(80)]
    texts += ["", None, "ab " * 5000, " ".join(words * 400), "a" * 9000]
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(0, texts[0], "c"), (None, "null id", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = P.pack(df).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t, _ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or min(2048, len(ids)), len(ids) + 1, 2048)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(x)[:5] for x in got), key=str) == sorted(want, key=str)
    by = defaultdict(list)
    for x in got:
        by[x["sequence_id"]].append((x["offset"], x["length"]))
    for items in by.values():
        items.sort()
        assert all(a == sum(n for _, n in items[:k]) for k, (a, _) in enumerate(items)) and sum(n for _, n in items) <= 2048
    assert len(by) == len(one_by_one([x[3] for x in want], 2048))
    assert P.pack(df.limit(0)).count() == 0


def test_long_runs_of_one_character(spark):
    """A million equal characters of ten kinds: the ids of the tokenizers library; and a table with such texts."""
    own, ids = P._encoder(public_tokenizers.path(P.VOCABULARY)), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for c in (" ", "\n", "\t", "\u00a0", "\u3000", "a", "!", "1", "é", "漢"):
        text = c * 10**6
        assert P.token_ids(own, text) == ids.encode(text, add_special_tokens=False).ids, repr(c)
    mixed = "one <|endoftext|>" + " " * 1_100_000 + "two<|endoftext|> three\n"
    assert P.token_ids(own, mixed) == [*own.encode("one "), 50256, *P.token_ids(own, " " * 1_100_000 + "two"), 50256, *own.encode(" three\n")]
    rows = spark.createDataFrame([(1, " " * 10**6), (2, "a b"), (3, "\n" * 10**6)], "doc_id long, text string")
    got = P.pack(rows).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in got} == {1: 10**6 + 1, 2: 3, 3: 500_001}
