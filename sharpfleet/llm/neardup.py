"""Near-duplicate documents by DartMinHash signatures over weighted word shingles.

Every shingle owns a region weight x rank. Darts fall into it at places that depend on the shingle alone; a document
sees those below its weight of the shingle and keeps, for each coordinate, the dart of the smallest rank. Two documents
agree in a coordinate with the probability of their weighted Jaccard similarity. Documents are only thrown as many
darts as fill the coordinates, whatever the number of shingles. A text that repeats shingles has a second signature, of
its shingle set.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharpfleet.llm.links import components
from sharpfleet.llm.store import Store
from sharpfleet.llm.textkit import chunked, mix, shingles

BANDS, ROWS = 40, 5
SIGNATURE = BANDS * ROWS
DOUBT = 5.7  # standard deviations of agreement within which the texts decide; beyond, once in 10^7


def weighted_shingles(texts: list[str], k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle, count) of all texts, sorted."""
    h, at = shingles(texts, k)
    order = np.lexsort((h, at))
    h, at = h[order], at[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    start = np.flatnonzero(first)
    return at[start], h[start], np.diff(np.append(start, len(h))).astype(np.float64)


def throw_darts(at: np.ndarray, item: np.ndarray, weight: np.ndarray, n: int, size: int = SIGNATURE) -> np.ndarray:
    """Signatures [n, size] of n weighted sets; rows of sets without weight are zero.

    at, item, weight: set index, 64-bit item and positive weight of each element. The region of an element is cut into
    cells of weight 1, each with its own Poisson stream of darts by rising rank; the last cell keeps the darts below the
    rest of the weight.
    """
    total = np.bincount(at, weight, n)
    cells = np.ceil(weight).astype(np.int64)
    owner, item = np.repeat(at, cells), np.repeat(item, cells)
    cell = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
    part = np.minimum(np.repeat(weight, cells) - cell, 1.0)
    seed = mix(item + mix(cell.astype(np.uint64) + np.uint64(1)))
    best, value = np.full(n * size, np.inf), np.zeros(n * size, np.uint32)
    limit = np.divide(size * (np.log(size) + 3), total, out=np.zeros(n), where=total > 0)
    todo = total > 0
    while todo.any():
        use = todo[owner]
        s, rank, own, p = seed[use], np.zeros(use.sum()), owner[use], part[use]
        turn = np.zeros(1, np.uint64)
        while len(s):
            turn += np.uint64(1)
            r = mix(s + turn * np.uint64(0x9E3779B97F4A7C15))
            rank = rank - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            on = rank < limit[own]
            s, rank, own, p, r = s[on], rank[on], own[on], p[on], r[on]
            d = mix(r + np.uint64(0xD1B54A32D192ED03))
            spot = own * size + ((d >> np.uint64(32)) % np.uint64(size)).astype(np.int64)
            hit = (mix(d) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < p
            spot, when, dart = spot[hit], rank[hit], d[hit].astype(np.uint32)
            np.minimum.at(best, spot, when)
            won = when == best[spot]
            value[spot[won]] = dart[won]
        todo &= np.isinf(best.reshape(n, size)).any(1)  # a coordinate without a dart: the same stream, further
        limit *= 2
    return value.reshape(n, size)


def with_signatures(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, two hashes of the exact text, and the signatures of shingle counts (null for texts without words) and of the shingle set (null where it is the same)."""

    def rows(batches):
        for b in batches:
            texts, sigs, sets = b["text"].tolist(), [], []
            for s in chunked(texts, 1 << 21):
                at, item, weight = weighted_shingles(texts[s], k)
                n = s.stop - s.start
                sig, some = throw_darts(at, item, weight, n).view(np.int32), np.bincount(at, minlength=n) > 0
                sigs += [row if x else None for row, x in zip(sig, some)]
                again = np.zeros(n, bool)
                again[at[weight > 1]] = True
                use = again[at]
                once = throw_darts(at[use], item[use], np.ones(use.sum()), n).view(np.int32)
                sets += [row if x else None for row, x in zip(once, again)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "t1": b["t1"], "t2": b["t2"], "sig": sigs, "once": sets})

    text = F.coalesce("text", F.lit(""))
    return docs.filter("doc_id is not null").select("doc_id", F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"), text.alias("text")).mapInPandas(
        rows, "doc_id long, t1 long, t2 long, sig array<int>, once array<int>")


def _similar(a: list[str], b: list[str], k: int) -> np.ndarray:
    """Jaccard similarity of each pair of texts: the larger of that of shingle sets and that of shingle counts."""
    out = np.zeros(len(a))
    for i, (x, y) in enumerate(zip(a, b)):
        _, p, m = weighted_shingles([x], k)
        _, q, n = weighted_shingles([y], k)
        both, i1, i2 = np.intersect1d(p, q, assume_unique=True, return_indices=True)
        low = np.minimum(m[i1], n[i2]).sum()
        out[i] = max(len(both) / max(1, len(p) + len(q) - len(both)), low / max(1, m.sum() + n.sum() - low))
    return out


def _links(pairs: DataFrame, reps: DataFrame, docs: DataFrame, least: float, k: int, store: Store, name: str) -> DataFrame:
    """Those of ``pairs`` (a, b) that are similar. Agreement of signatures settles clear pairs; the texts settle the others.

    Agreement, the larger of that of counts and that of sets, has a standard deviation of sqrt(s (1-s) / SIGNATURE), 0.028 at
    0.8; pairs within ``DOUBT`` of them are compared exactly.
    """
    doubt = DOUBT * (least * (1 - least) / SIGNATURE) ** 0.5
    one = lambda c: reps.select(F.col("doc_id").alias(c), F.col("sig").alias(f"s{c}"), F.col("once").alias(f"o{c}"))
    agree = lambda x, y: F.expr(f"aggregate(zip_with({x}, {y}, (x, y) -> if(x = y, 1, 0)), 0, (s, x) -> s + x)")
    once = F.when(F.expr("oa is not null or ob is not null"), agree("coalesce(oa, sa)", "coalesce(ob, sb)"))
    same = F.greatest(agree("sa", "sb"), once) / SIGNATURE
    tried = store.put(pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", same.alias("same")).filter(F.col("same") >= least - doubt), f"{name}-tried")

    @F.pandas_udf("double")
    def exact(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(_similar(x.tolist(), y.tolist(), k))

    text = lambda c: docs.select(F.col("doc_id").alias(c), F.coalesce("text", F.lit("")).alias(f"t{c}"))
    unsure = tried.filter(F.col("same") < least + doubt).join(text("a"), "a").join(text("b"), "b").filter(exact("ta", "tb") >= least)
    return tried.filter(F.col("same") >= least + doubt).select("a", "b").union(unsure.select("a", "b"))


def _whole_keys(batches, column: str):
    """Frames that hold all rows of their keys, from batches sorted by the key."""
    rest = []
    for b in batches:
        key = b[column].to_numpy()
        cut = int(np.searchsorted(key == key[-1], True)) if len(key) else 0
        if cut or rest and len(b) and rest[-1][column].iloc[-1] != key[0]:
            yield pd.concat([*rest, b.iloc[:cut]])
            rest = []
        if len(b):
            rest.append(b.iloc[cut:])
    if rest:
        yield pd.concat(rest)


def _slices(key: np.ndarray):
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
    return zip(at, [*at[1:], len(key)])


def _candidates(batches, floor: float):
    """Of each bucket those rows that agree, with a row of another label, in a share of ``floor`` of either signature. A pair counts in the first band that it shares of a signature only."""
    for b in _whole_keys(batches, "key"):
        sig = np.array(b["sig"].tolist(), np.int32).reshape(len(b), SIGNATURE)
        other = b["once"].notna().to_numpy()
        once = sig
        if other.any():
            once = sig.copy()
            once[other] = np.array(b["once"][other].tolist(), np.int32)
        label, slot, side, band = (b[c].to_numpy() for c in ("label", "slot", "side", "band"))
        use = np.zeros(len(b), bool)
        for x, y in _slices(b["key"].to_numpy()):
            for r in range(x, y - 1):
                to = np.flatnonzero((label[r + 1 : y] != label[r]) & ((side[r + 1 : y] == 0) | (slot[r + 1 : y] != slot[r]))) + r + 1
                for s, left in ((sig, to), (once, to if other[r] else to[other[to]])):
                    if len(left):
                        same = s[left] == s[r]
                        left, same = left[near := same.mean(1) >= floor], same[near]
                        left = left[same.reshape(-1, BANDS, ROWS).all(2).argmax(1) == band[r]]
                        use[left] = True
                        use[r] |= len(left) > 0
        yield b.loc[use, ["key", "doc_id", "label", "slot", "side"]]


def _spanning(batches, least: float, k: int):
    """Links between rows of different labels in a bucket that are similar; only those that join what was apart so far."""
    for b in _whole_keys(batches, "key"):
        ids, label, slot, side = (b[c].to_numpy() for c in ("doc_id", "label", "slot", "side"))
        texts, found = b["text"].tolist(), []
        for x, y in _slices(b["key"].to_numpy()):
            at, item, weight = weighted_shingles(texts[x:y], k)
            times = weight.astype(np.int64)
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            every = mix(np.repeat(item, times) + mix(nth.astype(np.uint64)))
            ways = [(at, item)] if (times == 1).all() else [(at, item), (np.repeat(at, times), every)]
            top: dict = {}

            def root(v):
                while top.setdefault(v, v) != v:
                    v = top[v]
                return v

            for own, item in ways:  # shingle sets, then shingles with their counts as sets of (shingle, how many)
                _, item = np.unique(item, return_inverse=True)
                order = np.argsort(item, kind="stable")
                begin = np.searchsorted(item[order], np.arange(item.max() + 2)) if len(item) else np.zeros(1, np.int64)
                holders, size = own[order], np.bincount(own, minlength=y - x)
                start = np.searchsorted(own, np.arange(y - x + 1))
                for r in range(y - x - 1):
                    mine = item[start[r] : start[r + 1]]
                    if not len(mine):
                        continue
                    both = np.bincount(np.concatenate([holders[begin[m] : begin[m + 1]] for m in mine]), minlength=y - x)
                    alike = (both >= least * (size + size[r] - both))[r + 1 :] & (label[x + r + 1 : y] != label[x + r]) & ((side[x] == 0) | (slot[x + r + 1 : y] != slot[x + r]))
                    for t in np.flatnonzero(alike) + r + 1:
                        if root(label[x + r]) != root(label[x + t]):
                            top[root(label[x + r])] = root(label[x + t])
                            found.append(sorted((ids[x + r], ids[x + t])))
        yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def near_duplicates(docs: DataFrame, least: float = 0.8, k: int = 5, block: int = 2000) -> DataFrame:
    """doc_id, copy_of (smallest id with exactly this text), class_id (smallest id of its class of near copies).

    Documents are linked when their shingles of ``k`` words, as sets or with counts, have a Jaccard similarity of ``least``
    or more; classes are the connected components. Equal texts are one node. Nodes that agree in a band of either signature share a bucket. First every node is
    compared with two nodes of its bucket (the extremes of a random order), which joins groups of copies at a cost
    linear in their size. Then buckets that still hold several components are searched for links between these: by
    signature, then by the texts, inside tasks that hold ``block`` nodes of a bucket, or two blocks, and return only links
    that join components. At 0.8 a pair shares none of the 40 bands
    once in 10^7, and as rarely do signatures of a pair that shares one differ so much that the texts are not compared. Texts without words are linked to equal texts only; null counts as empty; rows without id are left
    out; rows that repeat count once.
    """
    store = Store(docs.sparkSession)
    all_docs = store.put(with_signatures(docs, k), "all")
    first = all_docs.groupBy("t1", "t2").agg(F.min("doc_id").alias("copy_of"))
    copies = store.put(all_docs.select("doc_id", "t1", "t2").join(first, ["t1", "t2"]).select("doc_id", "copy_of").distinct(), "copies")
    nodes = copies.filter("doc_id = copy_of").select("doc_id")
    reps = store.put(all_docs.filter("sig is not null").select("doc_id", "sig", "once").hint("merge").join(nodes, "doc_id", "left_semi"), "reps")
    store.drop("all")
    values = lambda c: F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(i, F.slice(c, i * ROWS + 1, ROWS)).alias("bucket")))
    rows = reps.select("doc_id", F.inline(F.when(F.isnull("once"), values("sig")).otherwise(F.array_union(values("sig"), values("once")))))
    order = F.struct(F.xxhash64("doc_id").alias("o"), "doc_id")  # the same in every bucket, so the buckets of a group share their extremes
    ends = rows.groupBy("bucket").agg(F.min(order)["doc_id"].alias("low"), F.max(order)["doc_id"].alias("high")).filter("low <> high")
    held = store.put(rows.hint("merge").join(ends, "bucket"), "held")
    near = lambda c: held.filter(F.col("doc_id") != F.col(c)).select(F.least("doc_id", c).alias("a"), F.greatest("doc_id", c).alias("b"))
    pairs = store.put(near("low").union(near("high")).distinct(), "pairs")
    links = store.put(_links(pairs, reps, docs, least, k, store, "one"), "links")
    label = components(links, store, "first")
    told = held.hint("merge").join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("bucket", "band", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    told = store.put(told, "told")
    store.drop("held", "pairs")
    mixed = told.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n")).filter("x <> y")
    blocks = F.ceil(F.col("n") / block).cast("int")
    mixed = told.hint("merge").join(mixed.select("bucket", blocks.alias("blocks")), "bucket").withColumn("slot", F.pmod(F.xxhash64(F.lit(3), F.col("doc_id")), "blocks").cast("int"))
    mixed = mixed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.xxhash64("bucket", F.least("slot", "other"), F.greatest("slot", "other"))
    mixed = store.put(mixed.select(key.alias("key"), "band", "doc_id", "label", "slot", F.when(F.col("slot") == F.col("other"), 0).otherwise(1).alias("side")), "mixed")
    # side 0: a block with itself; 1: rows of two blocks (each row of the first meets those of the second)
    store.drop("told")
    floor = least - DOUBT * (least * (1 - least) / SIGNATURE) ** 0.5
    signed = mixed.hint("merge").join(reps, "doc_id").repartition("key").sortWithinPartitions("key")
    close = signed.mapInPandas(lambda it: _candidates(it, floor), "key long, doc_id long, label long, slot int, side int")
    close = store.put(close, "close")
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    exact = text.hint("merge").join(close, "doc_id").repartition("key").sortWithinPartitions("key")
    more = store.put(exact.mapInPandas(lambda it: _spanning(it, least, k), "a long, b long"), "more")
    store.drop("mixed", "close", "reps")
    if not more.isEmpty():
        label = components(links.union(more), store, "second")
    return copies.join(label.select(F.col("node").alias("copy_of"), "label"), "copy_of", "left").select("doc_id", "copy_of", F.coalesce("label", "copy_of").alias("class_id"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
