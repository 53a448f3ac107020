"""Quality of documents by a generalised additive model with pairwise interactions.

Every feature has a lookup table over its bins, some pairs of features a table over coarse bins; the score is the
logistic of the sum of one entry per table. The tables are learned by cyclic boosting: feature after feature, each
step adds a tree of three leaves, times a small rate, to that feature's table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharpfleet.llm.textkit import chunked, code_points, sums, words

FEATURES = (
    "log_chars", "log_words", "word_length", "long_words", "letters", "upper", "digits", "blanks", "common_marks", "symbols",
    "symbols_per_word", "marked_words", "words_per_line", "distinct_words", "distinct_lines", "distinct_pairs", "short_words", "non_ascii",
)
FIT_ROWS = 20_000  # most labelled rows that are fitted on


def _kinds() -> np.ndarray:
    """Kind of each code point below 0x3000: 1 letter, 2 upper-case letter, 3 digit, 4 blank, 5 sentence mark, 6 other."""
    kind = np.full(0x3000, 6, np.uint8)
    for i in range(0x3000):
        ch = chr(i)
        kind[i] = 2 if ch.isupper() else 1 if ch.isalpha() else 3 if ch.isdigit() else 4 if ch.isspace() else 5 if ch in ".,;:?'\"()-" else 6
    return kind


KINDS = _kinds()


def _distinct(keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of distinct keys between consecutive offsets."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    first = np.ones(len(k), bool)
    first[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[first], minlength=len(offsets) - 1)


def features(texts: list[str]) -> np.ndarray:
    """One row of ``FEATURES`` per text. An empty text has zeros."""
    out = [_features(texts[s]) for s in chunked(texts)]
    return np.vstack(out) if out else np.zeros((0, len(FEATURES)))


def _features(texts: list[str]) -> np.ndarray:
    c, at = code_points(texts)
    kind = np.where(c < 0x3000, KINDS[np.minimum(c, 0x2FFF)], 1)
    count = {k: sums(kind == k, at) for k in range(1, 7)}
    n = np.maximum(np.diff(at), 1)
    w, length, wat = words(texts)
    nw = np.maximum(np.diff(wat), 1)
    after = np.append(w[1:], np.uint64(0))[: len(w)]
    after[wat[1:][wat[1:] > wat[:-1]] - 1] = 0  # the last word of a text has none after it
    pairs = w * np.uint64(3) + after
    lines, lat = [], [0]
    for t in texts:
        lines += [hash(x) for x in t.split("\n")]
        lat.append(len(lines))
    lat = np.array(lat)
    nl = np.diff(lat)
    # a word is marked when a mark other than those of sentences ends it
    other = np.concatenate([kind == 6, [False]])
    blank = np.concatenate([kind == 4, [True]])
    marked = sums(other[:-1] & (blank[1:] | np.isin(np.arange(1, len(c) + 1), at)), at)
    return np.column_stack([
        np.log1p(np.diff(at)), np.log1p(np.diff(wat)), sums(length, wat) / nw, sums(length > 14, wat) / nw, (count[1] + count[2]) / n,
        count[2] / np.maximum(count[1] + count[2], 1), count[3] / n, count[4] / n, count[5] / n, count[6] / n, count[6] / nw, marked / nw,
        np.minimum(np.diff(wat) / nl, 200), _distinct(w, wat) / nw, _distinct(np.array(lines, np.int64), lat) / nl,
        _distinct(pairs, wat) / nw, sums(length <= 3, wat) / nw, sums(c > 127, at) / n,
    ]) * (np.diff(at) > 0)[:, None]


@dataclass
class AdditiveModel:
    """``tables[f]`` holds a value per bin of feature f, ``pairs`` maps (f, g) to a matrix over coarse bins."""

    edges: list = field(default_factory=list)
    coarse: list = field(default_factory=list)
    base: float = 0.0
    tables: list = field(default_factory=list)
    pairs: dict = field(default_factory=dict)

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            z += table[np.searchsorted(self.edges[f], x[:, f], side="right")]
        for (f, g), table in self.pairs.items():
            z += table[np.searchsorted(self.coarse[f], x[:, f], side="right"), np.searchsorted(self.coarse[g], x[:, g], side="right")]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _best_split(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and position of the best cut of a row of bins."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, leaves: int = 3) -> np.ndarray:
    """Values per bin of a tree with at most ``leaves`` leaves, grown by best gain."""
    spans = [(0, len(g))]
    while len(spans) < leaves:
        best = max(((*_best_split(g[a:b], h[a:b], ridge), a, b) for a, b in spans), key=lambda t: t[0])
        if best[0] <= 1e-9:
            break
        _, cut, a, b = best
        spans.remove((a, b))
        spans += [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and values of the tree that cuts the first axis once and both halves along the second."""
    best = (-1.0, np.zeros(g.shape))
    for cut in range(1, g.shape[0]):
        value, gain = np.zeros(g.shape), 0.0
        for rows in (slice(0, cut), slice(cut, None)):
            a, b = g[rows].sum(0), h[rows].sum(0)
            v = _tree(a, b, ridge, 2)
            value[rows] = v
            gain += float((2 * v * a - v * v * b).sum())
        if gain > best[0]:
            best = (gain, value)
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 6, rate: float = 0.1, bins: int = 32, coarse: int = 8, ridge: float = 2.0) -> AdditiveModel:
    """Cyclic boosting of main effects, then of the ``n_pairs`` pairs that explain most of the remaining gradient."""
    m = AdditiveModel()
    share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    m.base = float(np.log(share / (1 - share)))
    m.edges = [_edges(x[:, f], bins) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    m.coarse = [_edges(x[:, f], coarse) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    if len(np.unique(y)) < 2:
        return m
    at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(m.edges)]
    z = np.full(len(y), m.base)

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, table in enumerate(m.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(at[f], g, len(table)), np.bincount(at[f], h, len(table)), ridge)
            table += step
            z += step[at[f]]
    low = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(m.coarse)]

    def grid(f, b, s):
        n, k = len(m.coarse[f]) + 1, len(m.coarse[b]) + 1
        return np.bincount(low[f] * k + low[b], s, n * k).reshape(n, k)

    g, h = slopes()
    ranked = sorted(((_pair_tree(grid(a, b, g), grid(a, b, h), ridge)[0], a, b) for a, b in combinations(range(x.shape[1]), 2)), reverse=True)
    m.pairs = {(a, b): np.zeros((len(m.coarse[a]) + 1, len(m.coarse[b]) + 1)) for _, a, b in ranked[:n_pairs]}
    for _ in range(pair_rounds):
        for (a, b), table in m.pairs.items():
            g, h = slopes()
            step = rate * _pair_tree(grid(a, b, g), grid(a, b, h), ridge)[1]
            table += step
            z += step[low[a], low[b]]
    return m


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train, bound: int) -> DataFrame:
    """Texts of labelled rows that ``train`` (a condition on doc_id) admits: all, or a share by hash that gives about ``bound``."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_y")).filter(train)
    share = min(1.0, bound / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return docs.select("doc_id", "text").join(known, "doc_id")


def fit_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", train="true", bound: int = FIT_ROWS) -> AdditiveModel:
    """Fit on at most about ``bound`` labelled rows. Only their features, not their texts, reach the driver; no rows give an even score."""

    def rows(batches):
        for b in batches:
            x = features(b["text"].fillna("").tolist())
            yield pd.DataFrame({"x": list(x), "y": b["_y"].astype("float64")})

    got = labelled_sample(docs, labels, label, train, bound).mapInPandas(rows, "x array<double>, y double").toPandas()
    x = np.array(got["x"].tolist()).reshape(-1, len(FEATURES))
    order = np.lexsort(np.column_stack([x, got["y"]]).T) if len(x) else []
    return fit(x[order], got["y"].to_numpy()[order])


def score_documents(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """The rows of ``docs`` with ``score`` (replaced if there); a null text scores as an empty one."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(features(text.fillna("").tolist())), dtype="float64")

    return docs.withColumn("score", score("text"))


def held_out(every: int, rest: int):
    """Whether crc32 of the document's id, as text, leaves ``rest`` when divided by ``every``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % every == rest, F.lit(False))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_documents(docs, labels, "quality", ~held_out(5, 0))
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
