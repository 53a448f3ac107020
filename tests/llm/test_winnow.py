import hashlib

from pyspark.sql import functions as F

from sharpfleet.llm import winnow as W

from .common import empty, given, odd, prose


def test_windows_by_hand(spark):
    """Of every window of hashes the smallest is kept, the rightmost of equal ones, with its position."""
    texts = [prose(i, n) for i, n in enumerate((0, 1, 3, 4, 6, 7, 40, 300))] + ["a a a a a a a a a a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = W.fingerprints(docs).join(docs, "doc_id").collect()
    grams = docs.select("doc_id", F.split("text", r"\s+").alias("w")).collect()
    words = sorted({x for r in grams for x in r["w"]})
    one = {r[0]: r[1] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w")).collect()}
    pair = lambda ps: {(r[0], r[1]): r[2] for r in spark.createDataFrame(list(ps), "a long, b long").select("a", "b", F.xxhash64("a", "b")).collect()}
    h1 = {r["doc_id"]: [one[x] for x in r["w"]] for r in grams}
    p2 = pair({(a, b) for h in h1.values() for a, b in zip(h, h[1:] + [None])})
    h2 = {k: [p2[a, b] for a, b in zip(h, h[1:] + [None])] for k, h in h1.items()}
    p4 = pair({(a, b) for h in h2.values() for a, b in zip(h, h[2:] + [None, None])})
    for r in rows:
        h = [p4[a, b] & 0xFFFFFFFF for a, b in zip(h2[r["doc_id"]], h2[r["doc_id"]][2:] + [None, None])]
        h = h[: max(1, len(h) - W.K + 1)]
        want = {min((x, -i) for i, x in enumerate(h) if s <= i < s + W.W) for s in range(max(1, len(h) - W.W + 1))}
        assert [tuple(e) for e in r["fingerprint"]] == [(x, -i) for x, i in sorted(want, key=lambda z: -z[1])]


def test_shared_runs_share_an_entry(spark):
    shared = prose(3, W.K + W.W - 1)
    docs = spark.createDataFrame([(0, prose(1, 30) + " " + shared + " " + prose(2, 9)), (1, shared + " " + prose(4, 50))], "doc_id long, text string")
    a, b = ({e["hash"] for e in r["fingerprint"]} for r in W.fingerprints(docs).orderBy("doc_id").collect())
    assert a & b


def edited_by_hand(rows):
    """Rows with distinct ids, one of them null at most; that one comes last."""
    rows = sorted(((r["doc_id"], r["text"] or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    for i, (k, t) in enumerate(rows):
        m = len(t) // 3
        yield k, len(t), hashlib.sha256((t[: len(t) - m] + rows[(i + 1) % len(rows)][1][:m]).encode()).hexdigest()


def test_edited_texts(spark):
    for docs in (given(spark), odd(spark)):
        out = W.compare_edited(docs).collect()
        assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out), key=str) == sorted(edited_by_hand(docs.collect()), key=str)
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
        by_text = {}
        text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        for r in out:
            assert by_text.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    assert W.compare_edited(empty(spark)).count() == 0
    long = [r for r in W.compare_edited(given(spark)).collect() if r["n_chars"] > 500]
    assert sum(0.3 < r["near_edited"] < 0.8 for r in long) > 0.9 * len(long) and sum(r["near_next"] < 0.2 for r in long) > 0.9 * len(long)


def test_one_document_is_its_own_next(spark):
    out = W.compare_edited(spark.createDataFrame([(5, "abc def ghi")], "doc_id long, text string")).collect()
    assert out[0]["edited_sha256"] == hashlib.sha256(b"abc def abc").hexdigest() and out[0]["near_next"] == 1.0


def test_rows_that_repeat_have_one_result_each(spark):
    rows = [(1, prose(1)), (1, prose(1)), (1, prose(2)), (2, prose(3)), (2, prose(3)), (2, prose(3)), (None, prose(4)), (None, prose(4)), (None, None), (-(2**63), prose(5))]
    out = W.compare_edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in out) == sorted((str(k), len(t or "")) for k, t in rows)
    assert len({(r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_next"]) for r in out}) == len(set(rows))
    two = {r["edited_sha256"] for r in out if r["doc_id"] == 2}  # its next is one of the two texts of id 1
    tail = lambda t: hashlib.sha256((prose(3)[: len(prose(3)) - len(prose(3)) // 3] + t[: len(prose(3)) // 3]).encode()).hexdigest()
    assert len(two) == 1 and two <= {tail(prose(1)), tail(prose(2))}
