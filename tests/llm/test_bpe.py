import hashlib
import os
import random

import pytest
import public_tokenizers
import regex
import tiktoken

from tidebar.llm import bpe as B


@pytest.fixture(scope="module")
def bpe():
    return B.load(public_tokenizers.path(B.VOCABULARY))


@pytest.fixture(scope="module")
def library(bpe):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def strings():
    r = random.Random(7)
    words = ["the", "ing", "Über", "naïve", "日本語", "  ", "\n\n", "é", "😀", "it's", "123", "--", "tion", "aaaa", "==", "\t"]
    for _ in range(1500):
        yield "".join(r.choice(words) if r.random() < 0.6 else chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x2FFF)])) for _ in range(r.randint(0, 30)))
    yield "a" * 3000
    yield "abab" * 700
    yield " " * 999 + "x"


def test_same_ids_as_the_library(bpe, library):
    pieces = regex.compile(public_tokenizers.PATTERN).findall
    for s in strings():
        ids = [i for p in pieces(s) for i in bpe.encode(p.encode())]
        assert ids == library.encode_ordinary(s), s
        assert bpe.decode(ids) == s.encode()


def test_random_bytes_as_one_piece(bpe):
    r = random.Random(8)
    plain = tiktoken.Encoding("one", pat_str=r"[\s\S]+", mergeable_ranks=bpe.ranks, special_tokens={})
    for s in strings():
        if s:
            assert bpe.encode(s.encode()) == plain.encode_ordinary(s)
    assert r


def test_appends_and_edits(bpe):
    r = random.Random(9)
    text = "".join(r.choice("abcdefgh thein") for _ in range(3000)).encode()
    last: list[int] = []
    for at in range(0, len(text), 97):
        bpe.extend(text[: at + 97], last)
        assert bpe.walk_back(last) == bpe.walk_back(bpe.extend(text[: at + 97], []))
    for _ in range(30):
        at, gone = r.randrange(len(text)), r.randrange(5)
        new, table = bpe.edit(text, last, at, min(gone, len(text) - at), b"thing"[: r.randrange(6)])
        assert table == bpe.extend(new, [])
        text, last = new, table


def test_query_on_odd_rows(spark, library):
    rows = [(1, "Hello wörld", "x"), (2, "", "x"), (3, None, None), (None, "a\n\n b", "x"), (1, "Hello wörld", "x"), (4, "ab " * 50000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, B.encode(df).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert got == sorted(want, key=str)
    assert B.encode(df.limit(0)).count() == 0
    assert os.path.exists(public_tokenizers.path(B.VOCABULARY))
