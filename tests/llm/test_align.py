import hashlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from sharpfleet.llm import align as A

from .common import empty, given, odd

JSON, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def by_hand(rows):
    """Spans of both sides compared one by one, with the libraries that the files belong to."""
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    s = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    marks, out, counts = A.byte_of_mark(), [], Counter()
    for r in rows:
        raw = b" " + (r["text"] or "").encode()
        a = t.encode(" " + r["text"], add_special_tokens=False).ids if r["text"] else []
        b = s.encode(r["text"]) if r["text"] else []
        a_raw = [bytes(marks[c] for c in t.id_to_token(i)) for i in a]
        b_raw = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p[:3] == "<0x" else p.replace("▁", " ").encode() for p in map(s.id_to_piece, b)]
        if b"".join(a_raw) != raw or b"".join(b_raw) != raw:
            a = b = []
        ends = []
        for ids, side in ((a, a_raw), (b, b_raw)):
            at, spans = 0, []
            for i, x in zip(ids, side):
                spans.append((i, at, at + len(x)))
                at += len(x)
            ends.append(spans)
        b_at = {e: i for i, _, e in ends[1]}
        links = [(i, b_at[e]) for i, _, e in ends[0] if e in b_at]
        both = sorted({e for _, _, e in ends[0]} & set(b_at))
        cells = [[[] for _ in both] for _ in ends]
        for side, cell in zip(ends, cells):
            for i, _, e in side:
                cell[bisect_left(both, e)].append(str(i))
        groups = ["|".join(map(",".join, c)) for c in zip(*cells)]
        overlaps = sum(x < f and y < e for _, x, e in ends[0] for _, y, f in ends[1]) if len(a) < 400 else None
        counts.update(links)
        out.append((r["doc_id"], len(a), len(b), len(groups), links, ";".join(groups), overlaps))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(d, na, nb, ng, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
             hashlib.sha256(g.encode()).hexdigest() if na else "", over) for d, na, nb, ng, links, g, over in out]


def same(got, want):
    got, want = (sorted(map(tuple, x), key=str) for x in (got, want))
    assert [x[:8] for x in got] == [x[:8] for x in want]
    assert all(x[8] == y[8] for x, y in zip(got, want) if y[8] is not None)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps"]


def test_equals_brute_force(spark):
    docs = given(spark).limit(60)
    same(A.align_corpus(docs, JSON, PIECES).select(COLUMNS).collect(), by_hand(docs.collect()))


def test_odd_rows(spark, monkeypatch):
    rows = [(20, " two  blanks  and a tail "), (21, "▁ stands for a blank"), (22, "<|endoftext|><s></s><unk><0x41>"), (23, "日本語 \U0001f468‍\U0001f469 é"),
            (23, "日本語 \U0001f468‍\U0001f469 é"), (24, "\t\n \r\n"), (25, "\x00\x01\x7f"), (26, "ﬁ Å ½   　"), (None, "no id, twice"), (None, "no id, twice")]
    docs = odd(spark).unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    want = by_hand(docs.collect())
    for size in (A.CHUNK, 50):
        monkeypatch.setattr(A, "CHUNK", size)
        same(A.align_corpus(docs, JSON, PIECES).select(COLUMNS).collect(), want)
    assert A.align_corpus(empty(spark), JSON, PIECES).count() == 0 and A.align(empty(spark), JSON, PIECES).count() == 0


def test_alignment_rebuilds_the_text(spark):
    sides = A.Sides(JSON, PIECES)
    for r in odd(spark).join(A.align(odd(spark), JSON, PIECES), "doc_id").collect():
        raw = (" " + r["text"]).encode() if r["text"] else b""
        a, b = [sides.a_bytes[i] for i in r["a"]], [sides.b_bytes[i] for i in r["b"]]
        if not a:
            continue
        assert b"".join(a) == raw == b"".join(b) and r["ends"][-1] == len(raw)
        a_end, b_end = np.cumsum([len(x) for x in a]), np.cumsum([len(x) for x in b])
        assert sorted(set(a_end.tolist()) & set(b_end.tolist())) == r["ends"]
        for i, j in zip(r["over_a"], r["over_b"]):
            assert max(a_end[i] - len(a[i]), b_end[j] - len(b[j])) < min(a_end[i], b_end[j])


def test_pairs_stay_below_the_bound(spark):
    sides = A.Sides(JSON, PIECES)
    pairs = A.pair_counts(A.digest(given(spark), JSON, PIECES)).collect()
    assert 1000 < len(pairs) <= sides.most_pairs() < 1_000_000
    for r in pairs:
        x, y = sides.a_bytes[r["a"]], sides.b_bytes[r["b"]]
        assert x.endswith(y) or y.endswith(x)
