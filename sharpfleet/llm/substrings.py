"""Removal of repeated byte strings across all documents, by sorting suffixes at sampled anchors.

Every string of SPAN bytes holds an anchor, the place of the smallest rolling hash in it, which depends on its bytes
alone; so equal strings share an anchor at the same place in them. Anchors whose hash occurs once are done. Of the others,
the suffixes that begin there and the reversed prefixes that end there are sorted, which tells for every string around
an anchor where it stands first. The places of a frequent anchor are parted further by the bytes around it before they
are sorted, until a part fits into a task. Sorting is deep-shallow: multikey quicksort on keys of eight bytes down to a shallow
depth, then a blind trie for each group that is still together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharpfleet.llm.store import Store
from sharpfleet.llm.textkit import chunked, grams

SPAN = 100  # bytes of a repeated string
GRAM = 32  # bytes of an anchor
REACH = SPAN - GRAM  # an anchor begins at most so far into the string
SHALLOW = 3  # keys of eight bytes that multikey quicksort looks at
PART = 20_000  # places that are sorted together; larger groups are parted by further bytes
SALTS = 64  # shares of a group that is still too large
JOINED = 1 << 18  # characters whose anchors are found at once; about 100 bytes of arrays each
ROWS = 20_000  # rows that a task hands on at a time
KNOWN = 100_000  # surroundings that a task remembers to combine equal ones before the shuffle


def _slide(a: np.ndarray, width: int, pick) -> np.ndarray:
    """Extreme of every ``width`` consecutive elements, by doubling."""
    done = 1
    while 2 * done <= width:
        a = pick(a[:-done], a[done:])
        done *= 2
    return pick(a[: len(a) - (width - done)], a[width - done :]) if width > done else a


def anchors(data: bytes, offsets: np.ndarray) -> np.ndarray:
    """Places of anchors in texts that stand in ``data`` one after another. All places of the smallest hash of a string are anchors."""
    if len(data) < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = grams(np.frombuffer(data, np.uint8), GRAM)
    low = _slide(h, REACH + 1, np.minimum)
    start = np.arange(len(low))
    owner = np.searchsorted(offsets, start, side="right") - 1
    low = np.where(start + SPAN <= offsets[owner + 1], low, 0)  # strings do not cross texts
    pad = np.zeros(REACH, np.uint64)
    top = _slide(np.concatenate([pad, low, pad]), REACH + 1, np.maximum)
    at = np.flatnonzero((top == h) & (h > 0))
    return at, h[at]


class BlindTrie:
    """Trie over strings that keeps, per node, only the depth where its strings part; equal strings share a leaf."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None
        for i in range(len(strings)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        s, strings = self.strings[i], self.strings
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while isinstance(node, tuple):  # blind: look at one byte per node
            depth, kids = node
            node = kids.get(s[depth] if depth < len(s) else -1) or next(iter(kids.values()))
        other = strings[node[0]]
        n = min(len(s), len(other))
        same = next((k for k in range(n) if s[k] != other[k]), n)
        if same == len(s) == len(other):
            node.append(i)
            return
        parent, node = None, self.root
        while isinstance(node, tuple) and node[0] < same:
            parent, node = node, node[1][s[node[0]] if node[0] < len(s) else -1]
        key = s[same] if same < len(s) else -1
        if isinstance(node, tuple) and node[0] == same:
            node[1][key] = [i]
            return
        fork = (same, {key: [i], other[same] if same < len(other) else -1: node})
        if parent is None:
            self.root = fork
        else:
            parent[1][s[parent[0]] if parent[0] < len(s) else -1] = fork

    def order(self) -> list[int]:
        out, todo = [], [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo += [node[1][k] for k in sorted(node[1], reverse=True)]
            else:
                out += node
        return out


def deep_shallow(strings: list[bytes], group: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings by (group, string), and how many bytes each shares with the one before it (0 at the start of a group).

    ``skip``: bytes known to be equal within a group. A string that is the beginning of another comes first.
    """
    n, width = len(strings), -(-max(map(len, strings), default=0) // 8) * 8 or 8
    padded = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(n, width)
    keys = padded.view(">u8")
    order = np.argsort(group, kind="stable")
    segment = np.cumsum(np.concatenate([[0], group[order][1:] != group[order][:-1]])) if n else np.zeros(0, np.int64)
    first, last = skip // 8, min(skip // 8 + SHALLOW, width // 8)
    for j in range(first, last):  # multikey quicksort, all open segments at once: order by the key at this depth, part where it differs
        size = np.bincount(segment)
        open_ = np.flatnonzero(size[segment] > 1)
        if not len(open_):
            break
        key = keys[order[open_], j].astype(np.uint64)
        by = np.lexsort((key, segment[open_]))
        order[open_] = order[open_][by]
        key, seg = np.zeros(n, np.uint64), segment
        key[open_] = keys[order[open_], j]
        segment = np.cumsum(np.concatenate([[0], (seg[1:] != seg[:-1]) | (key[1:] != key[:-1])]))
    size = np.bincount(segment) if n else np.zeros(0, np.int64)
    begin = np.cumsum(size) - size
    for k in np.flatnonzero(size > 1):  # deep: blind tries
        part = order[begin[k] : begin[k] + size[k]].copy()
        deep = BlindTrie([strings[i][8 * last :] for i in part]).order()
        rest = part[deep]
        short = np.argsort([min(len(strings[i]), 8 * last) for i in rest], kind="stable")  # beginnings first
        order[begin[k] : begin[k] + size[k]] = rest[short]
    common = np.zeros(n, np.int64)
    for a in range(1, n, 1 << 16):
        b = min(n, a + (1 << 16))
        differ = padded[order[a:b]] != padded[order[a - 1 : b - 1]]
        lengths = np.array([min(len(strings[i]), len(strings[j])) for i, j in zip(order[a:b], order[a - 1 : b - 1])])
        common[a:b] = np.where(differ.any(1), np.minimum(differ.argmax(1), lengths), lengths)
        common[a:b][group[order[a:b]] != group[order[a - 1 : b - 1]]] = 0
    return order, common


def repeated_around(group: np.ndarray, left: list[bytes], right: list[bytes], rank: np.ndarray | None = None) -> list[tuple[int, int] | None]:
    """For places in rising order, with the bytes before and after: which strings around each stood around an earlier place of its group.

    The strings begin d bytes before the place; the answer is the largest and smallest such d, None if there is none.
    ``rank``: rises with the places; none of equal rank is earlier than another.
    """
    n = len(left)
    rank = np.arange(n) if rank is None else rank
    r_order, r_common = deep_shallow(right, group, GRAM)
    l_order, l_common = deep_shallow([s[::-1] for s in left], group)
    r_len, l_len = np.array([len(s) for s in right]), np.array([len(s) for s in left])
    boundary = np.concatenate([[True], group[l_order][1:] != group[l_order][:-1]])
    high, low = np.full(n, -1), np.full(n, SPAN)
    for d in range(REACH + 1):
        ok = np.flatnonzero((l_len >= d) & (r_len >= SPAN - d))
        if len(ok) < 2:
            continue
        rc, lc = np.zeros(n, np.int64), np.zeros(n, np.int64)
        rc[r_order] = np.cumsum(r_common < SPAN - d)
        lc[l_order] = np.cumsum((l_common < d) | boundary)
        key = rc[ok] * (n + 1) + lc[ok]
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        again = ok[rank[ok[first[inverse]]] < rank[ok]]
        high[again] = d
        low[again] = np.minimum(low[again], d)
    return [(int(a), int(b)) if a >= 0 else None for a, b in zip(high, low)]


def _whole(at: int, left: bytes, right: bytes) -> tuple[int, int] | None:
    """Bytes covered by all strings around an anchor."""
    most, least = min(REACH, len(left)), max(0, SPAN - len(right))
    return (at - most, at - least + SPAN) if most >= least else None


def spans_of(rows: list[tuple[int, int, int, int, bytes, bytes]]) -> list[tuple[int, int, int, int]]:
    """(doc_id, t, start, end) repeated around anchors. rows: hash, doc_id, hash t of the text, place, bytes before, bytes after; whole groups of a hash.

    Places are ordered by (doc_id, place), so equal places of rows that share an id do not count as repeats of each other.
    """
    out, seen = [], {}
    for h, doc, t, at, left, right in sorted(rows, key=lambda r: (r[1], r[3])):
        first = seen.setdefault((h, left, right), (doc, at, set()))
        if first[:2] == (doc, at):
            first[2].add(t)
        elif span := _whole(at, left, right):
            out.append((doc, t, *span))
    count: dict[int, int] = {}
    for h, _, _ in seen:
        count[h] = count.get(h, 0) + 1
    rest = [(h, left, right, *place) for (h, left, right), place in seen.items() if count[h] > 1]
    if rest:
        rank = np.cumsum([0, *(x[3:5] != y[3:5] for x, y in zip(rest, rest[1:]))])
        for r, found in zip(rest, repeated_around(np.array([r[0] for r in rest]), [r[1] for r in rest], [r[2] for r in rest], rank)):
            if found:
                out += [(r[3], t, r[4] - found[0], r[4] - found[1] + SPAN) for t in r[5]]
    return out


def around(batches):
    """Rows for ``settle`` from texts with their repeated places, in rising order of (doc_id, t): at most ROWS at a time."""
    last, rows, seen = None, [], {}

    def table():
        out = pd.DataFrame(rows, columns=["key", "doc_id", "t", "at", "left", "right", "start", "stop", "hot"]).astype({"start": "Int64", "stop": "Int64"})
        rows.clear()
        return out

    for b in batches:
        for doc, t, text, found_at in zip(b["doc_id"].tolist(), b["t"].tolist(), b["text"].tolist(), b["places"]):
            if (doc, t) == last:  # the row repeats
                continue
            last = doc, t
            raw = text.encode()
            for p in sorted(found_at, key=lambda p: p["at"]):
                h, at = p["h"], p["at"]
                left, right = raw[max(0, at - REACH) : at], raw[at : at + SPAN]
                if seen.setdefault((h, left, right), (doc, at)) < (doc, at):  # combined before the shuffle: it is not the first
                    if span := _whole(at, left, right):
                        rows.append((hash((doc, at)), doc, t, -1, None, None, *span, False))
                else:
                    seen[h, left, right] = (doc, at)
                    rows.append((h, doc, t, at, left, right, None, None, p["hot"]))
                if len(rows) >= ROWS:
                    yield table()
                if len(seen) >= KNOWN:  # forgotten ones are only combined later
                    seen.clear()
    yield table()


def repeated_spans(docs: DataFrame, copies: DataFrame, store: Store, part: int = PART) -> DataFrame:
    """(doc_id, t, spans): byte ranges to remove per text of an id, not merged; not for those of ``copies``.

    ``docs``: doc_id, text and its hash t, which tells texts of one id apart. Rows that repeat give their spans once.
    An anchor found more than ``part`` times is parted by the bytes around it, half of what is free at a time, until its
    parts are that small or hold one string each, of which the first place is an aggregate.
    """

    def find(batches):
        for b in batches:
            ids, t = b["doc_id"].to_numpy(), b["t"].to_numpy()
            texts = b["text"].tolist()
            for s in chunked(texts, JOINED):
                raw = [t.encode() for t in texts[s]]
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
                at, h = anchors(b"".join(raw), offsets)
                owner = np.searchsorted(offsets, at, side="right") - 1
                yield pd.DataFrame({"h": h.view(np.int64), "doc_id": ids[s][owner], "t": t[s][owner], "at": (at - offsets[owner]).astype(np.int32)})

    found = docs.mapInPandas(find, "h long, doc_id long, t long, at int")
    twice = found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h", (F.col("n") > part).alias("hot"))
    places = found.hint("merge").join(twice, "h").join(copies, ["doc_id", "t"], "left_anti")
    places = store.put(places.groupBy("doc_id", "t").agg(F.collect_set(F.struct("h", "at", "hot")).alias("places")), "places")

    text = docs.hint("merge").join(places, ["doc_id", "t"])
    # ids rise within a task, so the first of the equal surroundings that a task remembers is the earliest of them
    strings = text.sortWithinPartitions("doc_id", "t").mapInPandas(around, "key long, doc_id long, t long, at int, left binary, right binary, start long, stop long, hot boolean")
    fixed = [F.lit(0).alias("before"), F.lit(0).alias("after")]
    done = store.put(settle(strings.select("*", *fixed), part), "settled0")
    store.drop("places")
    spans, level = done.filter("start is not null").select("doc_id", "t", "start", "stop"), 0
    while not (open_ := done.filter("start is null")).isEmpty():
        level += 1
        same = open_.filter(F.col("before") + F.col("after") == REACH)
        spans = spans.unionByName(later_of_equal(same))
        parts = store.put(halves(open_.filter(F.col("before") + F.col("after") < REACH)), f"parts{level}")
        large = parts.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > part)
        hot = large.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("hot"))
        parts = parts.withColumn("salt", _salt()).join(hot, ["key", "salt"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        empty = [F.lit(None).cast("long").alias(c) for c in ("start", "stop")]
        done = store.put(settle(parts.select("*", *empty), part), f"settled{level}")
        store.drop(f"parts{level}")
        spans = spans.unionByName(done.filter("start is not null").select("doc_id", "t", "start", "stop"))
    return spans.groupBy("doc_id", "t").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def _salt():
    return F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALTS)).cast("int")


def settle(rows: DataFrame, part: int) -> DataFrame:
    """Spans of whole groups of ``key``; the rows of hot groups are handed on as they are, spread over tasks."""
    columns = ["key", "doc_id", "t", "at", "left", "right", "start", "stop", "before", "after"]
    schema = "key long, doc_id long, t long, at int, left binary, right binary, start long, stop long, before int, after int"

    def table(spans):
        out = pd.DataFrame(spans, columns=["doc_id", "t", "start", "stop"], dtype="Int64")
        return out.assign(key=0, at=-1, left=None, right=None, before=0, after=0)[columns]

    def run(batches):
        rest: list = []
        for b in batches:
            ready, hot = b["start"].notna().to_numpy(), b["hot"].to_numpy(bool)
            if (ready | hot).any():
                yield b.loc[ready | hot, columns].astype({"start": "Int64", "stop": "Int64"})
            rest += zip(*(b.loc[~ready & ~hot, c].tolist() for c in ("key", "doc_id", "t", "at", "left", "right")))
            if len(rest) > part and rest[0][0] != rest[-1][0]:
                cut = len(rest)
                while rest[cut - 1][0] == rest[-1][0]:
                    cut -= 1
                yield table(spans_of(rest[:cut]))
                rest = rest[cut:]
        if rest:
            yield table(spans_of(rest))

    spread = F.when(F.col("hot"), _salt() + 1).otherwise(0)
    return rows.withColumn("spread", spread).repartition("key", "spread").sortWithinPartitions("key").drop("spread", "salt").mapInPandas(run, schema)


def halves(rows: DataFrame) -> DataFrame:
    """The places of groups that agree in ``before`` and ``after`` bytes around the anchor, in two finer groupings each.

    A string has REACH bytes besides the anchor, so it has the upper half of those that are still free before the anchor
    or the other part after it. Each grouping holds the strings of one of these cases, and only the bytes that they reach.
    """
    free = REACH - F.col("before") - F.col("after")
    more = F.ceil(free / 2).cast("int")
    cases = F.array(
        F.struct((F.col("before") + more).alias("before"), F.col("after").alias("after")),
        F.struct(F.col("before").alias("before"), (F.col("after") + free - more + 1).alias("after")),
    )
    rows = rows.select("key", "doc_id", "t", "at", "left", "right", F.explode(cases).alias("c")).select("key", "doc_id", "t", "at", "left", "right", "c.*")
    most = F.least(REACH - F.col("after"), F.length("left"))
    rows = rows.filter((F.length("left") >= F.col("before")) & (F.length("right") >= GRAM + F.col("after")) & (most + F.length("right") >= SPAN))
    left = F.expr(f"substring(left, greatest(length(left) - ({REACH} - after), 0) + 1)")
    right = F.expr(f"substring(right, 1, {SPAN} - before)")
    rows = rows.select("key", "doc_id", "t", "at", left.alias("left"), right.alias("right"), "before", "after")
    near = F.expr("substring(left, length(left) - before + 1, before)"), F.expr(f"substring(right, {GRAM} + 1, after)")
    return rows.withColumn("key", F.xxhash64("key", "before", "after", *near))


def later_of_equal(rows: DataFrame) -> DataFrame:
    """Spans of strings that are one string each (``left`` and ``right`` hold nothing else) and are not its first place."""
    string = ["key", "before", "left", "right"]
    first = rows.groupBy(*string).agg(F.min(F.struct("doc_id", "at")).alias("first")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    later = rows.withColumn("salt", _salt()).join(first, [*string, "salt"]).filter(F.struct("doc_id", "at") > F.col("first"))
    start = (F.col("at") - F.col("before")).cast("long")
    return later.select("doc_id", "t", start.alias("start"), (start + SPAN).alias("stop"))


def merge(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return out


def remove_repeats(docs: DataFrame, part: int = PART) -> DataFrame:
    """doc_id, kept (remaining bytes), n_bytes, n_removed, n_spans of every document.

    A byte goes when a string of SPAN bytes over it also starts earlier: in a document of smaller id, or earlier in the
    same one. Strings are compared in the input. A document that equals an earlier one of SPAN bytes or more goes whole.
    Null texts are empty; rows without id are left out. Texts that share an id count as one document that has several bytes
    at a place: equal strings at the same place of them are no repeats, so rows that repeat have equal results.
    ``part``: places of an anchor that are sorted in one task at most; the result does not depend on it.
    """
    store = Store(docs.sparkSession)
    docs = docs.filter("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    keys = docs.select("doc_id", F.col("t").alias("t1"), F.sha2(F.encode("text", "UTF-8"), 256).alias("t2"), F.octet_length("text").alias("n")).filter(F.col("n") >= SPAN)
    first = keys.groupBy("t1", "t2").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).filter("c > 1")
    copies = store.put(keys.join(first, ["t1", "t2"]).filter("doc_id > first").select("doc_id", F.col("t1").alias("t")).distinct(), "copies")
    spans = repeated_spans(docs, copies, store, part)
    gone = spans.withColumn("copy", F.lit(False)).unionByName(copies.select("doc_id", "t", F.lit(None).cast("array<struct<start:long,stop:long>>").alias("spans"), F.lit(True).alias("copy")))

    def cut(batches):
        for b in batches:
            rows = []
            for doc, text, spans_, copy in zip(b["doc_id"].tolist(), b["text"].tolist(), b["spans"], b["copy"]):
                raw = text.encode()
                runs = [[0, len(raw)]] if copy is True else merge([(s["start"], s["stop"]) for s in spans_]) if spans_ is not None else []
                keep, at = [], 0
                for start, stop in runs:
                    keep.append(raw[at:start])
                    at = stop
                keep.append(raw[at:])
                kept = b"".join(keep)
                rows.append((doc, kept, len(raw), len(raw) - len(kept), len(runs)))
            yield pd.DataFrame(rows, columns=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return docs.hint("merge").join(gone, ["doc_id", "t"], "left").mapInPandas(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
