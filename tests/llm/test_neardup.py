import random

import numpy as np
import pandas as pd

from sharpfleet.llm import neardup as N
from sharpfleet.llm.links import components
from sharpfleet.llm.store import Store

from .common import empty, given, odd, prose


def grams(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def classes_by_hand(rows, least=0.8):
    docs = sorted({(r["doc_id"], r["text"] or "") for r in rows if r["doc_id"] is not None})
    parent, sets = {k: k for k, _ in docs}, {k: grams(t) for k, t in docs}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(docs):
        for b, t in docs[i + 1 :]:
            both = len(sets[a] & sets[b])
            if s == t or both and both / len(sets[a] | sets[b]) >= least:
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {k: top(k) for k, _ in docs}


def test_classes_equal_brute_force(spark):
    r = random.Random(7)
    rows = [(i, prose(i, 60)) for i in range(40)]
    for i in range(12):  # chains and groups of near copies
        words = rows[i][1].split()
        for k in range(r.randint(1, 5)):
            words[r.randrange(len(words))] = f"new{k}"
            rows.append((100 + 10 * i + k, " ".join(words)))
    made = spark.createDataFrame(rows, "doc_id long, text string")
    for docs in (made, given(spark), odd(spark)):
        got = {x["doc_id"]: x["class_id"] for x in N.near_duplicates(docs).collect()}
        want = classes_by_hand(docs.collect())
        assert got == want
    assert {x["doc_id"]: x["class_id"] for x in N.near_duplicates(made, block=3).collect()} == classes_by_hand(made.collect())
    assert N.near_duplicates(empty(spark)).count() == 0


def test_texts_alike_as_sets_only(spark):
    """A text and the same doubled or with a passage repeated often: alike as shingle sets, not with counts."""
    rows = []
    for i in range(6):
        text, passage = prose(i, 80), " ".join(prose(i, 80).split()[:30])
        rows += [(10 * i, text), (10 * i + 1, f"{text} {text}"), (10 * i + 2, f"{text} " + " ".join([passage] * 6)), (10 * i + 3, " ".join([text] * 5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (2000, 3):
        assert {x["doc_id"]: x["class_id"] for x in N.near_duplicates(docs, block=block).collect()} == classes_by_hand(docs.collect())
    assert set(classes_by_hand(docs.collect()).values()) == set(range(0, 60, 10))


def test_floor_keeps_pairs_at_the_limit():
    """Two rows of one band whose signatures agree in 0.67 of the places go on to the comparison of texts."""
    sig = np.arange(N.SIGNATURE, dtype=np.int32)
    near = np.where(np.arange(N.SIGNATURE) < 134, sig, -1).astype(np.int32)
    b = pd.DataFrame({"key": 1, "doc_id": [1, 2], "label": [1, 2], "slot": 0, "side": 0, "band": 0, "sig": [sig, near], "once": None})
    floor = 0.8 - N.DOUBT * (0.8 * 0.2 / N.SIGNATURE) ** 0.5
    assert floor < 0.67 and sum(len(x) for x in N._candidates(iter([b]), floor)) == 2


def test_agreement_is_weighted_jaccard():
    r = np.random.default_rng(2)
    items, n = r.integers(0, 1 << 63, 60).astype(np.uint64), 60
    for _ in range(6):
        a, b = r.integers(0, 4, n) * r.random(n) * 2, r.integers(0, 4, n) * r.random(n) * 2
        at = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        sig = N.throw_darts(at, np.concatenate([items[a > 0], items[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 2000)
        assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.05
    one = N.throw_darts(np.array([1]), items[:1], np.array([1.0]), 3)
    assert (one[1] != 0).all() and not one[0].any() and not one[2].any()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 51), (50, 52), (50, 50)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(edges, Store(spark), "t").collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 51: 50, 52: 50}
