import numpy as np

from sharpfleet.llm import toxicity as T
from sharpfleet.llm.quality import held_out

from .common import empty, odd, prose

WORDS = "zorgle zorgla zorgli zorglu brumvit brumvat brumvot".split()


def table(spark, n=600):
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        w = prose(i, 60).split()
        for k in range(3 * toxic):
            w.insert(7 * (k + 1), WORDS[(i // 5 + k) % len(WORDS)])
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_on_learned_words(spark):
    docs, labels = table(spark)
    g = T.fit_documents(docs, labels, "toxic", ~held_out(4, 2))
    assert any(k.startswith("zorg") for k in g.lexicon)
    rows = T.score_documents(docs.join(labels, "doc_id").filter(held_out(4, 2)), g).select("toxic", "score").collect()
    assert all((r["score"] >= 0.3) == (r["toxic"] == 1) for r in rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_grammar_weighs_clauses():
    g = T.Grammar({"idiot": 1.0}, np.array([-3.0, 1, 1, 0, 0]))
    w = lambda s: sum(g.clauses(s)[0])
    assert w("you are an idiot") > w("what an idiot") > w("not an idiot") > 0
    assert w("he said what an idiot") < w("what an idiot") and w("you idiot idiot") > 2 * w("you idiot")
    assert w("i will kill you") > 0 and w("we will burn them all") > 0 and w("you i will kill") > 0 and w("not a word here. you said nothing") == 0
    assert w("they burn bread") == w("they will burn bread") == w("they kill time and you burn bread") == 0 and w("they will kill every one of you") > 0
    assert w("they will not burn you") < w("we will burn you") and w("she said we will burn you") < w("we will burn you") and w("kill the lights") == w("burn. you") == 0
    assert w("you are fine. what an idiot") == w("what an idiot")  # a clause ends with its sentence
    assert g.score([""])[0] == g.score(["plain words"])[0] < 0.3


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (3, 0)], "doc_id long, toxic int")
    for docs, n in ((odd(spark), 15), (empty(spark), 0)):
        for y in (labels, labels.limit(0)):
            out = T.score_documents(docs, T.fit_documents(docs, y)).collect()
            assert len(out) == n and all(0 <= r["score"] <= 1 for r in out)


def spoken(n=800):
    """Clauses that differ in their grammar alone: insults and threats are toxic only when neither negated nor reported."""
    toxic = ["you are a zorgle", "we will burn you", "you brumvit", "i will kill them"]
    clean = ["nobody here is not a zorgle", "she said you are a zorgle", "he wrote we will burn you", "it is never a brumvit", "they burn bread", "kill the lights"]
    for i in range(n):
        yes = i % 2 == 0
        yield i, ". ".join([prose(i, 8), (toxic if yes else clean)[(i // 2) % (4 if yes else 6)], prose(i + 5000, 8)]), int(yes)


def auc(y, s):
    pos, neg = np.array(s)[np.array(y) == 1], np.array(s)[np.array(y) == 0]
    return float(((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean())


def test_grammar_beats_isolated_words():
    rows = list(spoken())
    g = T.Grammar({"zorgle": 3.0, "brumvit": 3.0}, np.zeros(5))
    read, y = [g.read(t) for _, t, _ in rows], np.array([v for _, _, v in rows], float)
    train = np.arange(len(rows)) % 5 != 4
    factors, coef = T.learn_factors([r for r, k in zip(read, train) if k], y[train])
    learned = T.Grammar(g.lexicon, coef, factors)
    flat = dict.fromkeys(T.FACTORS, 1.0)
    words = T.Grammar(g.lexicon, np.zeros(5), flat)
    words.coef = T.fit_logistic(words.features([t for (_, t, _), k in zip(rows, train) if k]), y[train])
    held = [t for (_, t, _), k in zip(rows, train) if not k]
    assert factors["negated"] < 0.4 or factors["reported"] < 0.6
    assert auc(y[~train], learned.score(held)) > 0.97 > auc(y[~train], words.score(held)) + 0.1


def test_arcs_without_clauses_keep_their_weights():
    g = T.Grammar({"zorgle": 1.0}, np.zeros(5))
    factors, _ = T.learn_factors([g.read("a zorgle" if i % 2 else prose(i, 9)) for i in range(60)], np.arange(60) % 2.0)
    assert factors == T.FACTORS
