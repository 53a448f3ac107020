"""Passages of benchmark items in documents, by q-gram filtering and banded alignment.

A stretch of n characters with at most e edits shares at least n + 1 - q (e + 1) q-grams with its original, on
diagonals that differ by e at most. Shared q-grams are counted in bands of diagonals that overlap by e, so that every
such stretch lies whole in one band; regions that reach the bound are aligned within their band.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharpfleet.llm.textkit import chunked, code_points, grams

Q = 8
STRETCH = 60  # a leak is a stretch of so many characters, or the whole of a shorter item
RATE = 0.05  # edits allowed per character
BAND = 16
BLOCK = 1_000_000  # characters of the benchmark that a task holds at a time
GAP = 0x110000  # between texts; no character has this code

LOWER = np.array([ord(x) if len(x := chr(i).lower()) == 1 and not chr(i).isspace() else 32 if chr(i).isspace() else i for i in range(0x3001)], np.uint32)


def plain(c: np.ndarray) -> np.ndarray:
    """Lower case, each white space a blank: one code point for one."""
    return np.where(c < len(LOWER), LOWER[np.minimum(c, len(LOWER) - 1)], c)


def fold(c: np.ndarray) -> np.ndarray:
    """Places of ``c`` that stay when each run of blanks becomes its first one."""
    blank = c == 32
    stays = np.ones(len(c), bool)
    stays[1:] = ~(blank[1:] & blank[:-1])
    return np.flatnonzero(stays)


@dataclass
class GramIndex:
    """q-grams of a block of items: distinct hashes, where the occurrences of each begin, and their item and position.

    ``short``: for each length below ``Q`` the hashes of the items of that length, in order, with their places in ``small``.
    """

    items: list
    codes: list
    size: np.ndarray
    edits: np.ndarray
    least: np.ndarray
    hashes: np.ndarray
    begin: np.ndarray
    item: np.ndarray
    at: np.ndarray
    seen: np.ndarray
    small: list
    short: dict


def build_index(items: list[tuple[int, str]]) -> GramIndex:
    """Index of (item_id, text). Items of fewer than ``Q`` characters have no q-gram and are kept to be matched whole; blank ones match nothing."""
    codes, ids, small = [], [], []
    for key, text in items:
        c = plain(code_points([" ".join(text.split())])[0])
        if len(c) >= Q:
            codes.append(c)
            ids.append(key)
        elif len(c):
            small.append((key, c))
    short = {}
    for m in sorted({len(c) for _, c in small}):
        of = [i for i, (_, c) in enumerate(small) if len(c) == m]
        hashed = np.array([grams(small[i][1], m)[0] for i in of], np.uint64)
        order = np.argsort(hashed, kind="stable")
        short[m] = hashed[order], np.array(of)[order]
    n = np.array([min(STRETCH, len(c)) for c in codes], np.int64)
    e = np.minimum((RATE * n).astype(np.int64), np.maximum(n // Q - 1, 0))
    h = [grams(c, Q) for c in codes]
    flat = np.concatenate(h) if h else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(h)), [len(x) for x in h])
    at = np.concatenate([np.arange(len(x)) for x in h]) if h else np.zeros(0, np.int64)
    order = np.argsort(flat, kind="stable")
    hashes, begin = np.unique(flat[order], return_index=True)
    seen = np.zeros(1 << 22, bool)
    seen[(hashes >> np.uint64(42)).astype(np.int64)] = True
    return GramIndex(ids, codes, n, e, n + 1 - Q * (e + 1), hashes, np.append(begin, len(flat)), owner[order], at[order], seen, small, short)


def banded_edits(a: np.ndarray, b: np.ndarray, size: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: fewest edits that turn ``a`` into some stretch of the first ``size`` elements of ``b``, and that stretch's ends.

    a [rows, n], b [rows, m]. All rows are aligned at once; only cells whose diagonal differs from the slack of ``b`` by
    ``reach`` at most are computed.
    """
    (rows, n), m = a.shape, b.shape[1]
    low, width, far = -reach, max(0, m - n) + 2 * reach + 1, 1 << 20
    col = np.arange(width)
    at = col + low  # position in b of the cells of row 0
    cost = np.where((at >= 0) & (at <= size[:, None]), 0, far)
    start = np.broadcast_to(at, cost.shape).copy()
    wide = np.full((rows, n + width + 2 * reach), -1, np.int64)  # b with room on both sides
    wide[:, reach : reach + m] = np.where(np.arange(m) < size[:, None], b, -1)
    edge = np.full((rows, 1), far)
    for i in range(1, n + 1):
        j = at + i
        new = cost + (wide[:, i - 1 : i - 1 + width] != a[:, i - 1, None])
        up = np.concatenate([cost[:, 1:], edge], 1) + 1
        take = up < new
        new = np.where(take, up, new)
        new_start = np.where(take, np.concatenate([start[:, 1:], edge], 1), start)
        new = np.where((j >= 0) & (j <= size[:, None]), new, far)
        # steps along the row: the cheapest earlier cell plus its distance
        slope = new - col
        best = np.minimum.accumulate(slope, 1)
        source = np.maximum.accumulate(np.where(slope == best, col, 0), 1)
        take = (best + col < new) & (j >= 0) & (j <= size[:, None])
        cost = np.where(take, best + col, new)
        start = np.where(take, np.take_along_axis(new_start, source, 1), new_start)
    end = cost.argmin(1)
    row = np.arange(rows)
    return cost[row, end], start[row, end], end + low + n


def candidates(c: np.ndarray, offsets: np.ndarray, index: GramIndex) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(text, item, places of the shared q-grams in the text, in the item) of regions with enough of them in a band."""
    none: list = []
    h = grams(c, Q)
    pos = np.flatnonzero(index.seen[(h >> np.uint64(42)).astype(np.int64)])
    if not len(pos) or not len(index.hashes):
        return none
    k = np.minimum(np.searchsorted(index.hashes, h[pos]), len(index.hashes) - 1)
    hit = index.hashes[k] == h[pos]
    pos, k = pos[hit], k[hit]
    times = index.begin[k + 1] - index.begin[k]
    where = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(index.begin[k], times)
    pos, item, at = np.repeat(pos, times), index.item[where], index.at[where]
    text = np.searchsorted(offsets, pos, side="right") - 1
    diagonal = pos - at + (1 << 20)
    band, over = diagonal // BAND, diagonal % BAND < index.edits[item]
    pos, item, at, text = (np.concatenate([x, x[over]]) for x in (pos, item, at, text))
    band = np.concatenate([band, band[over] - 1])
    order = np.lexsort((pos, band, item, text))
    pos, item, at, text, band = (x[order] for x in (pos, item, at, text, band))
    # a place in the text counts once in a band, however many places of the item it equals
    once = np.ones(len(pos), bool)
    once[1:] = (pos[1:] != pos[:-1]) | (band[1:] != band[:-1]) | (item[1:] != item[:-1]) | (text[1:] != text[:-1])
    once = np.flatnonzero(once)
    p, it, tx, bd = pos[once], item[once], text[once], band[once]
    last = np.arange(len(p)) + index.least[it] - 1
    ok = last < len(p)
    last = np.minimum(last, len(p) - 1)
    ok &= (tx[last] == tx) & (it[last] == it) & (bd[last] == bd) & (p[last] - p <= index.size[it] + index.edits[it] - Q)
    first = np.flatnonzero(ok)
    if not len(first):
        return none
    last = last[first]
    new = np.ones(len(first), bool)  # windows that overlap in one band are one region
    new[1:] = first[1:] > np.maximum.accumulate(last)[:-1]
    run = np.flatnonzero(new)
    a, b = once[first[run]], np.append(once, len(pos))[np.maximum.reduceat(last, run) + 1] - 1
    return [(int(text[x]), int(item[x]), pos[x : y + 1], at[x : y + 1]) for x, y in zip(a, b)]


def whole_items(c: np.ndarray, offsets: np.ndarray, index: GramIndex) -> list[tuple[int, int, int, int]]:
    """(text, item id, start, end) of items below ``Q`` characters in ``c``, equal and not inside a longer word or number."""
    found = []
    letter = lambda x: chr(x).isalnum() if x < GAP else False
    for m, (hashes, of) in index.short.items():
        h = grams(c, m)
        lo, hi = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
        for at in np.flatnonzero(hi > lo):
            for key, code in (index.small[i] for i in of[lo[at] : hi[at]]):
                before, after = int(c[at - 1]) if at else GAP, int(c[at + m])
                if np.array_equal(c[at : at + m], code) and not (letter(before) and letter(int(code[0]))) and not (letter(after) and letter(int(code[-1]))):
                    text = int(np.searchsorted(offsets, at, side="right")) - 1
                    found.append((text, key, int(at - offsets[text]), int(at - offsets[text]) + m))
    return found


def leaks(texts: list[str], index: GramIndex) -> list[tuple[int, int, int, int, int, int, int]]:
    """(text index, item id, start, end, item start, item end, edits) of verified stretches, in code points."""
    found = []
    for s in chunked(texts):
        part = texts[s]
        c, _ = code_points([t + "\0" for t in part])
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])])
        c = plain(c)
        c[offsets[1:] - 1] = GAP
        stays, whole, known = fold(c), offsets, len(found)
        c = c[stays]
        offsets = np.searchsorted(stays, whole)
        for text, item, x, y in whole_items(c, offsets, index):
            found.append((s.start + text, item, x, y, 0, y - x, 0))
        for text, item, pos, at in candidates(c, offsets, index):
            a, begin, stop = index.codes[item], int(offsets[text]), int(offsets[text + 1]) - 1
            n, e, least = int(index.size[item]), int(index.edits[item]), int(index.least[item])
            i0, i1, slack = int(at.min()), int(at.max()) + Q, BAND + e
            lo, hi = max(begin, int(pos[0]) - slack), min(stop, int(pos[-1]) + Q + slack)
            if i1 - i0 >= n:
                edits = int(RATE * (i1 - i0))
                if np.array_equal(c[pos[0] : pos[0] + i1 - i0], a[i0:i1]):
                    found.append((s.start + text, index.items[item], int(pos[0]) - begin, int(pos[0]) - begin + i1 - i0, i0, i1, 0))
                    continue
                if len(np.unique(at)) >= i1 - i0 + 1 - Q * (edits + 1):  # the bound for the region as a whole
                    cost, x, y = (int(v[0]) for v in banded_edits(a[None, i0:i1], c[None, lo:hi], np.array([hi - lo]), slack))
                    if cost <= edits:
                        found.append((s.start + text, index.items[item], lo - begin + x, lo - begin + y, i0, i1, cost))
                        continue
            # else the stretches of n characters that hold enough of the shared q-grams
            first = np.arange(max(0, i0 - n + Q), min(len(a) - n, i1 - Q) + 1)
            places = np.unique(at)
            held = np.searchsorted(places, first + n - Q, side="right") - np.searchsorted(places, first)
            first = first[held >= least]
            if not len(first):
                continue
            near = np.clip(np.searchsorted(at, first), 0, len(at) - 1) if (np.diff(at) >= 0).all() else np.zeros(len(first), np.int64)
            lo = np.maximum(begin, first + (pos - at)[near] - slack)
            size = np.minimum(stop - lo, n + 2 * slack)
            ok = size >= n - e
            first, lo, size = first[ok], lo[ok], size[ok]
            if not len(first):
                continue
            cells = np.arange(n + 2 * slack)
            part = c[np.minimum(lo[:, None] + cells, len(c) - 1)]
            cost, x, y = banded_edits(a[first[:, None] + np.arange(n)], part, size, slack)
            good = cost <= e
            if good.any():
                first, lo, x, y = first[good], lo[good] - begin, x[good], y[good]
                found.append((s.start + text, index.items[item], int((lo + x).min()), int((lo + y).max()), int(first.min()), int(first.max()) + n, int(cost[good].min())))
        for i in range(known, len(found)):  # back to the places of the text as it stands
            text, item, x, y, *rest = found[i]
            begin = int(offsets[text - s.start])
            x, y = (int(v) - int(whole[text - s.start]) for v in (stays[begin + x], stays[max(begin + y - 1, begin)] + 1))
            found[i] = (text, item, x, max(x, y), *rest)
    return sorted(set(found))


def blocks(benchmark: DataFrame, size: int = BLOCK) -> list[GramIndex]:
    """Indexes of the benchmark's items in blocks of about ``size`` characters, dealt by hash."""
    items = benchmark.filter("item_id is not null and text is not null").select("item_id", "text")
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = -(-total // size)
    block = F.pmod(F.xxhash64("item_id"), F.lit(max(n, 1)))
    return [build_index([(r[0], r[1]) for r in items.filter(block == i).orderBy("item_id").toLocalIterator()]) for i in range(n)]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per stretch of a document that repeats one of a benchmark item: doc_id, item_id, start, end, item_start, item_end, edits.

    A stretch has ``STRETCH`` characters or more (or is a whole shorter item) and at most ``RATE`` edits per character,
    apart from case, kind and length of white space. An item of fewer than ``Q`` characters has no edits and is no part of
    a longer word. Null texts have none, rows that repeat or share an id each have their own; items without id or text
    are no items. Documents are scanned once per block of the benchmark
    and are not shuffled.
    """
    schema = "doc_id long, item_id long, start long, end long, item_start long, item_end long, edits long"

    def scan(index):
        def rows(batches):
            for b in batches:
                ids = b["doc_id"].astype(object).where(b["doc_id"].notna(), None).tolist()
                got = leaks(b["text"].fillna("").tolist(), index)
                yield pd.DataFrame([(ids[r[0]], *r[1:]) for r in got], columns=[x.split()[0] for x in schema.split(", ")]).astype({"doc_id": "Int64"})

        return docs.select("doc_id", "text").mapInPandas(rows, schema)

    parts = [scan(index) for index in blocks(benchmark)]
    out = parts[0] if parts else docs.sparkSession.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.union(p)
    return out


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a stretch of a benchmark item."""

    def clean(index):
        @F.pandas_udf("boolean")
        def none(text: pd.Series) -> pd.Series:
            out = np.ones(len(text), bool)
            out[[r[0] for r in leaks(text.fillna("").tolist(), index)]] = False
            return pd.Series(out)

        return none

    for index in blocks(benchmark):
        docs = docs.filter(clean(index)("text"))
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
