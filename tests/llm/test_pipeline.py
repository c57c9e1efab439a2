import random
import re
import zlib

import corpus_pipeline as C
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidebar.llm.toxicity import classify, train


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in ((a or "").split(), (b or "").split()))
    return len(x & y) / len(x | y) if x and y else 0.0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    r = random.Random(17)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(2000)]
    docs, labels = [], []
    for i in range(260):
        w = [r.choice(words) for _ in range(r.randint(30, 160))]
        toxic = i % 5 == 0
        if toxic:
            w[3] = w[9] = w[20] = r.choice(["scum", "moron"])
        docs.append((i, " ".join(w), "en", f"src{i % 3}"))
        labels.append((i, 1, int(toxic)))
    base = docs[7][1]
    docs += [(300, base.replace(" ", "\n"), "en", "a"), (301, base + " extra tail words", "en", "a"), (302, "call +1 (702) 555-0742 or write ann@b.org " + docs[8][1], "en", "a"), (303, None, "en", "a"), (304, "", "en", "a"), (None, "no id at all here today friends", "en", "a"), (305, " ".join(words) * 3, "en", "b")]
    docs += [docs[9], docs[9]]
    rows = [(*d, len(d[1] or ""), "x") for d in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, class string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {name: None for name, _ in C.STAGES}
    now = docs
    for name, stage in C.STAGES:
        now = C.cut(stage(spark, now, folder))
        kept[name] = now
        if name != "packing":
            assert now.schema == docs.schema
    rows = {name: [(r["doc_id"], r["text"]) for r in df.collect()] if name != "packing" else df.collect() for name, df in kept.items()}
    chain = train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    toxic = {r["doc_id"] for r in classify(docs, chain).collect() if r["toxic"]}
    assert toxic == {i for i in range(0, 260, 5)}
    assert sorted(rows["toxicity"], key=repr) == sorted(((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] not in toxic), key=repr)
    first: dict[str, tuple] = {}
    for i, t in sorted(rows["toxicity"], key=lambda x: (x[0] is None, x[0] or 0)):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), (i, t))
    assert sorted(rows["exact_dedup"], key=repr) == sorted(first.values(), key=repr)
    stay: list[tuple] = []
    for i, t in sorted(rows["exact_dedup"], key=lambda x: (x[0] is None, x[0] or 0)):
        if all(jaccard(t, u) < 0.8 and (t or "").split() != (u or "").split() for _, u in stay):
            stay.append((i, t))
    assert sorted(rows["near_dedup"], key=repr) == sorted(stay, key=repr)
    assert 300 not in {i for i, _ in stay} and 301 not in {i for i, _ in stay}
    private = dict(rows["pii"])[302] if 302 in dict(rows["near_dedup"]) else None
    changed = [i for (i, t), (j, u) in zip(sorted(rows["near_dedup"], key=repr), sorted(rows["pii"], key=repr)) if t != u]
    assert changed == ([302] if private else []) and (private is None or "ann@b.org" not in private and "702" not in private)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in rows["pii"]:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or min(2048, len(ids)), len(ids) + 1, 2048)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r)[:5] for r in rows["packing"]), key=repr) == sorted(want, key=repr)


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert C.run(spark, folder).count() > 100
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0
