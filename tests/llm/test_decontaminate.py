import random

import numpy as np

from sharpfleet.llm import decontaminate as D

from .common import empty, given, odd, prose


def edits(a, b):
    """Fewest edits from a to a stretch of b, all cells."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_banded_alignment_equals_the_full_one():
    r = random.Random(1)
    for _ in range(200):
        a = [r.randint(0, 3) for _ in range(r.randint(1, 30))]
        b = [r.randint(0, 3) for _ in range(5)] + [x if r.random() > 0.1 else 9 for x in a if r.random() > 0.05] + [r.randint(0, 3) for _ in range(5)]
        cost, x, y = (int(v[0]) for v in D.banded_edits(np.array([a]), np.array([b]), np.array([len(b)]), 40))
        assert cost == edits(a, b) and 0 <= x <= y <= len(b) and edits(a, b[x:y]) == cost


def test_given_tables_hold_whole_items(spark):
    docs, items = given(spark).collect(), given(spark, "benchmark").collect()
    truth = {(d["doc_id"], b["item_id"]) for d in docs for b in items if b["text"] in d["text"]}
    found = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(given(spark), given(spark, "benchmark")).collect()}
    assert truth and found == truth
    kept = {r["doc_id"] for r in D.drop_leaked(given(spark), given(spark, "benchmark")).collect()}
    assert kept == {d["doc_id"] for d in docs} - {d for d, _ in truth}


def test_edits_and_parts():
    item = prose(5, 40)
    index = D.build_index([(3, item), (4, "short"), (5, prose(6, 40))])
    r = random.Random(2)

    def with_edits(s, n):
        s = list(s)
        for i in r.sample(range(len(s)), n):
            s[i] = r.choice(["#", "", s[i] + "#"])
        return "".join(s)

    n = len(item)
    texts = [prose(7) + " " + item.upper().replace(" ", "\n") + " " + prose(8), prose(7) + with_edits(item, int(n * 0.04)) + prose(8), item[20:90], item[:50], prose(9, 3000), "", item[:60] + prose(7) + item[-60:]]
    got = D.leaks(texts, index)
    assert {g[0] for g in got} == {0, 1, 2, 6} and {g[1] for g in got} == {3}
    first = next(g for g in got if g[0] == 0)
    assert texts[0][first[2] : first[3]].lower().replace("\n", " ") == item and first[6] == 0


def test_bound_of_the_lemma():
    """Stretches with no more edits than the budget are never missed."""
    r = random.Random(3)
    for seed in range(40):
        item = prose(seed, 30)[: D.STRETCH].strip()
        budget = int(D.RATE * len(item))
        s = list(item)
        for i in r.sample(range(1, len(s) - 1), budget):
            s[i] = "#"
        assert D.leaks([prose(seed + 500) + "".join(s) + prose(seed + 900)], D.build_index([(1, item)]))


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "this line of well over forty characters is in many documents."), (None, "x"), (2, None), (3, "")], "item_id long, text string")
    assert {r["doc_id"] for r in D.find_leaks(odd(spark), items).collect()} == {1, 2, 3, 4, 5, 6, 7, 11}
    assert D.drop_leaked(odd(spark), items).count() == 7 and D.drop_leaked(odd(spark), items).columns == odd(spark).columns
    assert D.find_leaks(empty(spark), items).count() == 0 and D.find_leaks(odd(spark), items.limit(0)).count() == 0
    assert len(D.blocks(items, 10)) == 7  # several blocks


def test_blanks_and_short_items():
    """Runs of blanks count as one, in the item and the text; items without a q-gram match whole."""
    item = prose(5, 40)
    index = D.build_index([(3, item), (4, "7 x 8=?"), (5, "  "), (6, "ab")])
    texts = [
        prose(7) + "  " + item.replace(" ", "  ") + " " + prose(8), item.replace(" ", "\n     "), "   what  is 7 \t x\n 8=? Say", "17 x 8=? cab abs", "AB", "x" * 9 + " ab",
        "\u3000" + item.replace(" ", "\u3000 "), "", "   "]
    got = D.leaks(texts, index)
    assert {(t, i) for t, i, *_ in got} == {(0, 3), (1, 3), (2, 4), (4, 6), (5, 6), (6, 3)}
    for t, i, x, y, *_ in got:
        assert " ".join(texts[t][x:y].lower().split()) == {3: item, 4: "7 x 8=?", 6: "ab"}[i] and not texts[t][x].isspace() and not texts[t][y - 1].isspace()


def test_stretches_equal_brute_force_with_edits_and_blanks():
    """Whole items with and without edits, blanks doubled: found exactly where the full alignment is within the budget."""
    r = random.Random(7)
    items = [(i, prose(i, 25)[: D.STRETCH].strip()) for i in range(6)]
    index, texts = D.build_index(items), []
    for n in range(60):
        body = list(items[n % 6][1])
        for at in r.sample(range(len(body)), n % 8):
            body[at] = r.choice(["#", "", body[at] + "#"])
        texts.append(prose(n + 300, 20) + " " + "".join(body).replace(" ", " " * r.randint(1, 3)) + " " + prose(n + 600, 20))
    found = {(t, i) for t, i, *_ in D.leaks(texts, index)}
    folded = [" ".join(t.split()) for t in texts]
    assert found == {(t, i) for t, text in enumerate(folded) for i, item in items if edits(item, text) <= min(int(D.RATE * len(item)), len(item) // D.Q - 1)}
