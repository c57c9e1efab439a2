import random
import re
import string

from tidebar.llm.quality import base, outside, quality_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    covered = set()
    for i in range(len(words) - 4):
        if sum(words[j : j + 5] == words[i : i + 5] for j in range(len(words) - 4)) > 1:
            covered |= set(range(i, i + 5))
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def texts():
    r = random.Random(2)
    yield from (None, "", " \n\t", "a", "a b c d e a b c d e", "x\n x\nx\n\n\nx", "é ü # $ < >", "a " * 500)
    for _ in range(60):
        yield "".join(r.choice(["a", "b", "c", "é"]) + r.choice([" ", " ", "\n", "\t", "\x0b", " "]) for _ in range(r.randint(0, 60)))


def test_base_counts_against_brute_force():
    for t in texts():
        assert base(t) == brute(t), t


def test_bands():
    assert outside(0.5, 100) == 0 and outside(0.05, 1000) == -1 and outside(0.99, 1000) == 1 and outside(0.5, 10**7) == 0


def test_verdicts(spark):
    r = random.Random(4)
    vocabulary = ["".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    clean = " ".join(r.choice(vocabulary) for _ in range(3000))
    noise = " ".join("".join(r.choice(string.printable[:94]) for _ in range(12)) for _ in range(400))
    nearly = " ".join("word%d" % (i % 3) if i % 7 else "w%d" % i for i in range(2000))
    rows = [(1, clean, 0), (2, noise, 0), (3, nearly, 0), (4, clean[:12000] + noise * 4, 0), (5, None, 0), (6, "", 0), (1, clean, 0), (None, clean, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = {(x["doc_id"], x["kept"]) for x in quality_rules(df).collect()}
    assert got == {(1, True), (2, False), (3, False), (4, False), (5, False), (6, False), (None, True)}
    assert quality_rules(df).count() == len(rows) and quality_rules(df.limit(0)).count() == 0


def test_very_long_texts(spark):
    """Two megabytes of ordinary prose, and the same with one half said over and over."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(5000)]
    clean = " ".join(r.choice(vocabulary) for _ in range(300_000))
    rows = [(1, clean), (2, clean[:300_000] + " " + "again and again " * 100_000)]
    got = {x["doc_id"]: x for x in quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(clean) > 1.8e6 and got[1]["kept"] and got[1]["n_words"] == 300_000 and not got[2]["kept"]
