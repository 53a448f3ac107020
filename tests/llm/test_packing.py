import collections
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sharpfleet.llm import packing as P

from .common import empty, given, odd

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def check(docs, out):
    """Every id in one piece, sequences gapless and short enough; returns the share of padding."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == {d["doc_id"] for d in docs}
    for d in docs:
        ids, at = np.array(t.encode(d["text"] or "", add_special_tokens=False).ids + [0], "<u4"), 0
        for r in sorted(pieces[d["doc_id"]], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert "ids" not in r or r["ids"] == ids[at : at + r["length"]].tolist()
            at += r["length"]
        assert at == len(ids)
    total = padding = 0
    for s in sequences.values():
        end = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= 1024
        total, padding = total + end, padding + (0 if end & (end - 1) == 0 else 1024 - end)
    return padding / max(1, total)


def test_round_trip(spark):
    docs = given(spark)
    assert check(docs.collect(), P.pack(docs, PATH).collect()) < 0.01
    assert check(docs.collect(), P.pack(docs, PATH, group=20, with_ids=False).collect()) < 0.2


def test_odd_rows(spark):
    assert check(odd(spark).collect(), P.pack(odd(spark), PATH).collect()) < 0.2
    assert P.pack(empty(spark), PATH).count() == 0


def test_first_fit_decreasing_by_hand():
    r = random.Random(4)
    for _ in range(50):
        sizes = [r.randint(1, 50) for _ in range(r.randint(1, 60))]
        room, want = [50] * len(sizes), [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            want[i] = next(b for b, free in enumerate(room) if free >= sizes[i])
            room[want[i]] -= sizes[i]
        assert P.first_fit_decreasing(sizes, 50) == want


def test_gaps_are_filled():
    bins = P.fill_gaps([[(0, 0, 900)], [(1, 0, 800)], [(2, 0, 1024)], [(3, 0, 700), (4, 0, 3)]], 1024, 8)
    used = sorted(sum(p[2] for p in b) for b in bins)
    assert sum(used) == 900 + 800 + 1024 + 703 and used[1:] == [1024] * (len(used) - 1)
