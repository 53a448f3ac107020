import hashlib
import random
from pathlib import Path

import numpy as np
import pandas as pd

from sharpfleet.llm import store
from sharpfleet.llm import substrings as S

from .common import empty, given, odd, prose


def by_hand(rows):
    seen = set()
    for k, text in sorted((r["doc_id"], r["text"] or "") for r in rows if r["doc_id"] is not None):
        b = text.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        yield k, len(b), sum(gone), sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(bytes(v for v, g in zip(b, gone) if not g)).hexdigest()


def same(docs, part=S.PART):
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in S.remove_repeats(docs, part).collect())
    assert got == sorted(by_hand(docs.collect()))
    return sum(r[2] for r in got)


def test_given_documents(spark):
    assert same(given(spark)) > 0


def test_passages_with_neighbours(spark):
    r = random.Random(5)
    passages = [prose(i, n) for i, n in ((1, 25), (2, 30), (3, 60), (4, 18))] + ["é" * 51, "ab" * 80]
    docs = [(i, " ".join(x for _ in range(r.randint(1, 4)) for x in (prose(100 + 7 * i + r.randint(0, 5), r.randint(0, 20)), r.choice(passages)[r.randint(0, 4) :]))) for i in range(60)]
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, passages[2] * 3), (103, "x" * 99), (104, "x" * 100), (105, "x" * 101), (106, "x" * 700), (107, passages[0][:99])]
    assert same(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)) > 0
    same(odd(spark))
    assert S.remove_repeats(empty(spark)).count() == 0


def test_frequent_anchors_are_parted(spark):
    """A passage between ever new neighbours, some of them shared in part: parts of two places give what one task would."""
    r = random.Random(8)
    passage, sides = "~" + prose(50, 22) + "~", [prose(60 + i, 30) for i in range(4)]
    docs = []
    for i in range(24):
        left, right = r.choice(sides)[-r.randint(0, 80) :], r.choice(sides)[: r.randint(0, 80)]
        docs.append((i, f"{prose(200 + i, r.randint(0, 12))}{left}{passage}{right}{prose(300 + i, r.randint(0, 12))}"))
    docs += [(30, passage), (31, passage[: S.SPAN]), (32, passage[-S.SPAN :]), (33, passage + passage), (34, None)]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert same(docs, 2) == same(docs) > 0


def test_halves_cover_every_string_once():
    cases, leaves = [(0, 0)], []
    while cases:
        before, after = cases.pop()
        free = S.REACH - before - after
        if free == 0:
            leaves.append(before)
            continue
        more = -(-free // 2)
        cases += [(before + more, after), (before, after + free - more + 1)]
    assert sorted(leaves) == list(range(S.REACH + 1))


def by_place(rows):
    """As by_hand, where the first place of a string is that of the smallest (doc_id, start) of all rows."""
    rows = [(r["doc_id"], r["text"].encode()) for r in rows]
    first: dict = {}
    for k, b in rows:
        for s in range(len(b) - 99):
            first[b[s : s + 100]] = min(first.get(b[s : s + 100], (k, s)), (k, s))
    for k, b in rows:
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if first[b[s : s + 100]] < (k, s):
                gone[s : s + 100] = b"\1" * 100
        yield k, len(b), sum(gone), hashlib.sha256(bytes(v for v, g in zip(b, gone) if not g)).hexdigest()


def test_rows_that_share_an_id(spark):
    """Rows that repeat keep their text; different texts of one id are cut by their own spans."""
    a, b, c = prose(1, 40), prose(2, 40), prose(3, 40)
    rows = [(1, a), (1, a), (2, b + " " + a), (2, b + " " + a), (2, c), (3, "x " + b), (3, c + " " + b), (3, c), (4, a), (4, a), (4, prose(4, 40)), (5, c + c), (5, c + c), (5, "é" * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(by_place(docs.collect()))
    assert [w[2] for w in want[:2]] == [0, 0]
    for n in (1, 5):
        got = S.remove_repeats(docs.repartition(n)).collect()
        assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], hashlib.sha256(r["kept"]).hexdigest()) for r in got) == want


def test_deep_shallow_sorts():
    r = random.Random(6)
    for _ in range(60):
        base = [bytes(r.choice(b"\x00ab") for _ in range(r.randint(0, 60))) for _ in range(6)]
        strings = [r.choice(base)[: r.randint(0, 60)] + bytes(r.choice(b"ab") for _ in range(r.randint(0, 4))) for _ in range(r.randint(1, 80))]
        group = np.array([r.randint(0, 3) for _ in strings])
        order, common = S.deep_shallow(strings, group)
        assert sorted(order.tolist()) == list(range(len(strings)))
        got, want = [(group[i], strings[i]) for i in order], sorted((g, s) for g, s in zip(group.tolist(), strings))
        assert [x[0] for x in got] == [x[0] for x in want]
        for depth in (1, 5, 24, 30, 50):  # strings that reach a depth are grouped there as in sorted order
            label = np.cumsum(common < depth)
            classes = {}
            for i, c in zip(order, label):
                if len(strings[i]) >= depth:
                    classes.setdefault((group[i], strings[i][:depth]), set()).add(c)
            assert all(len(c) == 1 for c in classes.values()) and len({next(iter(c)) for c in classes.values()}) == len(classes)


def test_blind_trie_orders_equal_and_nested_strings():
    strings = [b"b", b"", b"ba", b"b", b"bab", b"a", b"baa", b""]
    assert [strings[i] for i in S.BlindTrie(strings).order()] == sorted(strings)


def test_every_string_holds_an_anchor_at_the_same_place():
    text = (prose(8, 200) + "z" * 150 + prose(9, 50)).encode()
    data, offsets = text + text[50:900], np.array([0, len(text), len(text) + 850])
    at, h = S.anchors(data, offsets)
    of = lambda s: {int(a) - s for a in at if s <= a <= s + S.REACH}
    for s in range(len(text) - S.SPAN):
        assert of(s)
    for s in range(750):
        low = lambda x: min((hv, a - x) for a, hv in zip(at.tolist(), h.tolist()) if x <= a <= x + S.REACH)
        if s % 37 == 0:
            assert low(50 + s)[0] == low(len(text) + s)[0]


def test_rows_around_anchors_come_in_bounded_tables(monkeypatch):
    """Many places of one batch: tables stay small, and what a task forgot or remembers of another batch gives the same spans."""
    text = prose(70, 400)
    at = range(0, len(text) - S.SPAN, 2)
    places = [{"h": 5 * k, "at": k, "hot": False} for k in at]
    batches = [pd.DataFrame({"doc_id": [2 * i, 2 * i + 1], "t": [7, 7], "text": [text, text], "places": [places, places]}) for i in range(2)]

    def run(rows, known):
        monkeypatch.setattr(S, "ROWS", rows)
        monkeypatch.setattr(S, "KNOWN", known)
        tables = list(S.around(iter(batches)))
        assert max(map(len, tables)) <= rows
        return pd.concat(tables)

    few, all_ = run(50, 10**6), run(10**6, 10**6)
    assert len(few) == len(all_) == 4 * len(at) and few["start"].notna().sum() == all_["start"].notna().sum() == 3 * len(at)
    assert run(50, 100)["start"].notna().sum() == 0  # forgotten: left to the sort


def test_files_of_a_round_go_with_it(spark, tmp_path, monkeypatch):
    """The job that is left finds the spans and the copies only; shuffle files and tables of the jobs before are gone."""
    files = lambda: set(Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].toString()).glob("*/shuffle_*.data"))
    r = random.Random(8)
    passage = "~" + prose(50, 22) + "~"
    rows = [(i, f"{prose(200 + i, r.randint(0, 12))}{passage}{prose(300 + i, r.randint(0, 12))}") for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(store, "shared_folder", lambda _: str(tmp_path))
    before, was = files(), spark.conf.get(store.FREED)
    out = S.remove_repeats(docs, 2)
    left = files() - before
    assert {p.name[:7] for p in tmp_path.iterdir()} == {"copies", "settled"}
    assert not left and spark.conf.get(store.FREED) == was
    assert sum(r["n_removed"] for r in out.collect()) == sum(r[2] for r in by_hand(docs.collect())) > 0
