import random
from collections import Counter

import numpy as np

from tidebar.llm import near_dedup as N


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in ((a or "").split(), (b or "").split()))
    return len(x & y) / len(x | y) if x and y else 0.0


def classes(rows):
    parent = {i: i for i, _, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, a, _) in enumerate(rows):
        for j, b, _ in rows[:n]:
            if (a or "").split() == (b or "").split() or jaccard(a, b) >= 0.8:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in parent}


def corpus():
    r = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.randint(60, 300))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 6)):
            new = list(base)
            for _ in range(r.randint(1, max(1, len(new) // 50))):
                new[r.randrange(len(new))] = r.choice(words)
            texts.append(" ".join(new))
            if r.random() < 0.4:
                base = new  # chains: the ends are less similar than the links
    texts += ["", None, "  \n", "few words", "few  words", "one two three four five", "a " * 400, "a " * 700, texts[3], texts[3]]
    r.shuffle(texts)
    return [(i, t, "x") for i, t in enumerate(texts)]


def test_classes_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, class string")
    got = {x["doc_id"]: x for x in N.near_duplicates(df).collect()}
    want = classes(rows)
    sizes = Counter(want.values())
    assert {i: (x["class_id"], x["class_size"], x["kept"]) for i, x in got.items()} == {i: (c, sizes[c], c == i) for i, c in want.items()}


def test_repetition_in_one_copy_only(spark):
    """Links are decided on sets: how often one copy repeats a passage must not keep its pair from being compared."""
    r = random.Random(23)
    rows = []
    for k in range(80):
        base = [f"w{r.randrange(10**6)}" for _ in range(400)]
        new = list(base)
        for i in range(7):
            new[200 + 25 * i] = f"v{r.randrange(10**6)}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(new[:120] * 19 + new))]
        assert 0.8 <= jaccard(rows[-2][1], rows[-1][1]) < 0.84
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["class_id"] for x in got} == {i: i - i % 2 for i, _ in rows}


def test_odd_rows(spark):
    rows = [(None, "a b c d e f", "x"), (None, "q r s t u v", "x"), (4, "a b c d e f", "x"), (4, "a b c d e f", "x"), (9, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kid string")
    got = sorted(map(tuple, N.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 4, 3, False), (4, 4, 3, True), (4, 4, 3, False), (9, 9, 1, True), (None, None, 1, True)], key=str)
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_estimates_probability_jaccard():
    r = np.random.default_rng(3)
    h = r.integers(0, 2**63, 300).astype(np.uint64)
    wa, wb = r.random(300) + 0.1, r.random(300) + 0.1
    keep = r.random(300) < 0.8
    want = sum(1 / np.maximum(wa / x, wb / y).sum() for x, y in zip(wa, wb))
    found = []
    for trial in range(20):
        g = N.mix(h + np.uint64(trial))
        sig = N.prob_min_hash(np.repeat([0, 1], 300), np.concatenate([g, g]), np.concatenate([wa, wb]), 2)
        assert (sig != 0).all()
        found.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(found) - want) < 0.03
    assert keep.any()


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100 + r.randrange(30), 100 + r.randrange(30)) for _ in range(40)]
    nodes = sorted({x for e in edges for x in e} | {500, 501})
    parent = {n: n for n in nodes}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = N.components(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "a long, b long"))
    assert {x["id"]: x["class"] for x in got.collect()} == {n: root(n) for n in nodes}


def test_very_long_texts_and_ids_with_several_texts(spark):
    """Texts of 200,000 words, one with a few words changed; and one id with two texts, each near to another document."""
    r = random.Random(31)
    words = [f"w{i}" for i in range(20_000)]
    long = [r.choice(words) for _ in range(200_000)]
    near = list(long)
    for _ in range(500):
        near[r.randrange(len(near))] = "x"
    a, b = ([r.choice(words) for _ in range(120)] for _ in range(2))
    rows = [(1, " ".join(long)), (2, " ".join(near)), (5, " ".join(a)), (5, " ".join(b)), (7, " ".join(a + ["end"])), (8, " ".join(["start"] + b)), (9, "some thing else with other words")]
    for part in (spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3)):
        got = sorted((x["doc_id"], x["class_id"], x["class_size"], x["kept"]) for x in N.near_duplicates(part).collect())
        assert got == [(1, 1, 2, True), (2, 1, 2, False), (5, 5, 4, False), (5, 5, 4, True), (7, 5, 4, False), (8, 5, 4, False), (9, 9, 1, True)]
        assert N.drop_near_copies(part).count() == 3


def test_second_signature_estimates():
    """One-bit registers differ by half of what the sets do."""
    import pyarrow as pa

    r = random.Random(6)
    words = [f"w{i}" for i in range(5000)]
    base = [r.choice(words) for _ in range(3000)]
    other = base[:2600] + [r.choice(words) for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([" ".join(base), " ".join(other)])], names=["id", "text"])
    (out,) = N._bits(iter([batch]))
    x, y = (np.array(v, np.int64).astype(np.uint64) for v in out.column("bits").to_pylist())
    differ = sum(bin(int(p ^ q)).count("1") for p, q in zip(x, y))
    j = jaccard(" ".join(base), " ".join(other))
    assert abs((1 - 2 * differ / (64 * N.LONGS)) - j) < 4 * 2 * ((1 + j) * (1 - j) / 4 / (64 * N.LONGS)) ** 0.5
    assert N.DIFFER == int((1 - 0.7469) / 2 * 2048)


def test_every_id_is_an_id(spark):
    """Both ends of 64 bits, hashes as ids, and rows without an id."""
    words = lambda k, n=30: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [(-(2**63), words(1)), (2**62, words(1)), (2**63 - 1, words(2)), (2**63 - 2, words(2) + " more"), (None, words(2)), (None, words(3)), (2**62 + 5, words(3)), (None, words(4)), (None, words(4)), (-1, words(5))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(x) for x in N.near_duplicates(df).select("doc_id", "class_id", "class_size", "kept").collect()), key=str)
    low = -(2**63)
    want = [(low, low, 2, True), (2**62, low, 2, False), (2**63 - 1, 2**63 - 2, 3, False), (2**63 - 2, 2**63 - 2, 3, True), (None, 2**63 - 2, 3, False), (None, 2**62 + 5, 2, False), (2**62 + 5, 2**62 + 5, 2, True), (-1, -1, 1, True), (None, None, 2, True), (None, None, 2, False)]
    assert got == sorted(want, key=str)
    stay = sorted((str(x["doc_id"]) for x in N.drop_near_copies(df).collect()))
    assert stay == sorted(map(str, (low, 2**63 - 2, 2**62 + 5, None, -1)))
