"""Suffix-array deduplication against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quadlake.llm import suffix_dedup as S


def brute(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


def corpus(seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé ") for _ in range(r.randint(1, 6)))
    make = lambda n: " ".join(word() for _ in range(n))
    shared = [make(60) for _ in range(4)]
    texts = [make(r.randint(1, 120)) for _ in range(40)]
    for k in range(40):
        texts.append(make(r.randint(0, 20)) + r.choice(shared) + make(r.randint(0, 30)))
    base = make(200)
    for k in range(30):  # near copies
        w = base.split(" ")
        w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    return [*texts, texts[0], texts[0], "a" * 900, "xy" * 300, "", None, shared[0] * 3]


def test_suffix_array_and_common_prefixes():
    r = random.Random(1)
    for _ in range(30):
        buf = bytes(r.choice(b"ab") for _ in range(r.randint(1, 300)))
        order = S.suffix_array(buf)
        assert order.tolist() == sorted(range(len(buf)), key=lambda i: buf[i:])
        lcp = S.common_prefixes(buf, order, 50)
        for k in range(1, len(buf)):
            a, b = buf[order[k - 1] :], buf[order[k] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[k] == min(n, 50)


@pytest.mark.parametrize("split", [2000, 3])
def test_against_brute_force(spark, split):
    texts = corpus()
    rows = [(i if i != 7 else None, t, "x", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, l long")
    got = S.remove_repeats(spark, docs, length=100, digest=True, shard_contexts=split, shard_bytes=4000).collect()
    want = brute([(t or "").encode() for t in texts], 100)
    found = {g.doc_id: (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got}
    assert len(got) == len(rows)
    for i, w in enumerate(want):
        assert found[i if i != 7 else None] == w


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(spark, docs).collect() == []
