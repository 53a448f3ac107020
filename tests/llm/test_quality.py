import random

import numpy as np

from sharpfleet.llm import quality as Q

from .common import empty, given, odd, prose


def table(spark, n=500):
    r, docs, labels = random.Random(1), [], []
    for i in range(n):
        bad = i % 4 == 0
        text = prose(i, r.randint(30, 200))
        if bad:
            text = " ".join(w + "###" for w in text.split()) if i % 8 else text.upper().replace(" ", "!! ")
        docs.append((i, text))
        labels.append((i, int(not bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy(spark):
    docs, labels = table(spark)
    m = Q.fit_documents(docs, labels, "quality", ~Q.held_out(5, 0))
    rows = Q.score_documents(docs.join(labels, "doc_id").filter(Q.held_out(5, 0)), m).collect()
    assert len(rows) > 50 and sum((r["score"] >= 0.3) == (r["quality"] == 1) for r in rows) >= 0.98 * len(rows)
    small = Q.labelled_sample(docs, labels, "quality", "true", 100).count()
    assert 60 < small < 140


def test_lookup_tables_and_pairs():
    """A main effect is learned by one table, an exclusive-or only by a pair."""
    r = np.random.default_rng(1)
    x = r.random((4000, 3))
    m = Q.fit(x, (x[:, 0] > 0.6).astype(float))
    assert ((m.score(x) > 0.5) == (x[:, 0] > 0.6)).mean() > 0.98
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    pair, none = Q.fit(x, y, rounds=30, pair_rounds=150), Q.fit(x, y, rounds=30, pair_rounds=150, n_pairs=0)
    assert (0, 1) in pair.pairs and ((pair.score(x) > 0.5) == (y == 1)).mean() > 0.9 > 0.7 > ((none.score(x) > 0.5) == (y == 1)).mean()


def test_features_do_not_depend_on_neighbours(spark):
    texts = [r["text"] for r in given(spark).limit(40).collect()] + ["", "x", "\n", "a\x00b"]
    assert np.allclose(Q.features(texts), np.vstack([Q.features([t]) for t in texts])) and Q.features([]).shape == (0, len(Q.FEATURES))


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (8, 1), (None, 1), (3, None), (3, 0), (3, 0)], "doc_id long, quality int")
    for docs, n in ((odd(spark), 15), (empty(spark), 0)):
        for y in (labels, labels.limit(0)):
            out = Q.score_documents(docs, Q.fit_documents(docs, y)).collect()
            assert len(out) == n and all(0 <= r["score"] <= 1 for r in out)
