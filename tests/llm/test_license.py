import re

from pyspark.sql import functions as F

from sharpfleet.llm import license as L

from .common import empty, given, odd, prose


def by_hand(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for label, p in L.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_phrases_equal_brute_force(spark):
    extra = spark.createDataFrame([
        (9001, "CC-BY cc by, CC\nBY"), (9002, "All rights reserved. all RIGHTS reserved"), (9003, "cc"), (9004, "GNU General Public License v3 and cc by-nc"), (9005, "a" * 200_000),
        (9006, "cc by " * 3000), (9007, "ccby accby cc_by Émile général public license")], "doc_id long, text string")
    for docs in (given(spark).select("doc_id", "text").union(extra), odd(spark)):
        want = {r["doc_id"]: by_hand(r["text"]) for r in docs.collect()}
        got = {r["doc_id"]: tuple(r)[1:6] for r in L.scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()}
        assert got == want
    assert L.scan(empty(spark)).count() == 0


def test_spans_of_templates(spark):
    mit = L.SENTENCES[-1][1]
    words = mit.split()
    cut = words[:8] + ["really"] + words[8:]  # one word more: two neighbouring diagonals
    docs = spark.createDataFrame([(1, prose(1) + " " + mit.upper() + " " + prose(2)), (2, " ".join(cut)), (3, " ".join(words[:5])), (4, prose(3, 4000)), (5, mit + " " + prose(4) + " " + mit)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in L.scan(docs).collect()}
    assert [got[i]["labels"] for i in (1, 2, 3, 4, 5)] == ["mit", "mit", "", "", "mit"]
    assert got[1]["score"] == 1.0 and 0.8 < got[2]["score"] < 1 and 0 < got[3]["score"] < 0.5 and got[4]["score"] == 0
    spans = L.spans(docs.filter("doc_id = 5")).filter((F.col("cover") >= 0.5) & F.col("label").isNotNull()).orderBy("first").collect()
    assert [(s["first"], s["end"]) for s in spans] == [(0, len(words)), (len(words) + 120, 2 * len(words) + 120)]


def test_repeated_phrases_are_no_licence(spark):
    """Places of a template count once; spans are no longer than the template and a few words."""
    scattered = " ".join(w for i in range(20) for w in [*"the mit license".split(), *prose(i, 40).split()])
    docs = spark.createDataFrame([(1, "the mit license the mit license"), (2, "the mit license " * 500), (3, scattered), (4, "released under the mit license"), (5, "the mit license. Released under the MIT license.")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in L.scan(docs).collect()}
    assert [got[i]["labels"] for i in (1, 2, 3, 4, 5)] == ["", "", "", "mit", "mit"]
    assert got[1]["score"] == got[2]["score"] == got[3]["score"] < 0.5 and got[4]["score"] == got[5]["score"] == 1.0


def test_each_row_has_its_result_and_only_ascii_is_lowered(spark):
    rows = [(None, "cc by"), (None, "cc by"), (None, "all rights reserved"), (None, None), (1, "cc by"), (1, "cc by cc by"), (1, "cc by"), (2, "\u212a cc by"), (3, "CC BY \u212aind")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_base"], r["base_labels"]) for r in L.scan(docs).collect())
    want = sorted((str(k), n, c, b) for k, t in rows for n, c, _, _, b in [by_hand(t)])
    assert got == want
    assert L.words(F.col("text")) is not None and docs.filter("doc_id = 2").select(L.words(F.col("text")).alias("w")).first()["w"] == ["\u212a", "cc", "by"]
