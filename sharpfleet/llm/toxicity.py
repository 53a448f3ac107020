"""Toxicity of documents by a weighted finite-state grammar over clauses.

Words are read as symbols: insults (with a weight learned from labelled rows), threats, people addressed, negations,
verbs of report. Five transducers with weights are composed into one machine, which reads each clause that holds an
insult or a threat and pays out its weight: more when somebody is addressed, less when negated or reported. A threat
pays when a target stands before it or follows in its clause. The weights of the arcs are learned from the clauses of
the labelled rows. The score of a document is a logistic function of the weights of its clauses.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharpfleet.llm.quality import held_out, labelled_sample
from sharpfleet.llm.textkit import mix, shingles

FIT_ROWS = 12_000  # most labelled rows that are fitted on
ENTRIES = 5_000  # most learned entries of the lexicon
PREFIXES = (4, 5, 6)

SYMBOLS = OTHER, INSULT, THREAT, TARGET, NOT, REPORT, SUBJECT, AUX = range(8)

# fixed values: closed classes of words in four languages
TARGETS = "your yours yourself him his her them their dir dich dein deine euch sie te toi ton ta tes vous votre vos ti".split()
SUBJECTS = "you u he she they du ihr tu il elle vosotros tú usted ustedes él ella ellos".split()  # the doer when a threat follows, else a target
AUXILIARIES = "will would shall should can could may might must do does did have has gonna going to am are is werden werde wirst wird kann muss vais va vas veux peux voy vas puedo".split()
NEGATIONS = "not no never neither nor isn't aren't wasn't don't doesn't didn't without kein keine keinen nicht nie niemals ohne ne pas jamais sans ni nunca jamás sin".split()
REPORTS = "said says say saying told tells claimed claims reported reportedly allegedly called calls quote quoted wrote sagte sagt behauptet nannte schrieb dit disait affirme appelé écrit dijo dice afirma llamó escribió".split()
THREATS = "kill hurt destroy beat stab shoot burn murder strangle töten umbringen schlagen vernichten tuer frapper détruire matar golpear destruir".split()
INSULTS = "idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting clown dummkopf abschaum imbécile crétin idiote estúpido estúpida imbécil basura".split()

TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]+")
FIXED = {w: (k, 1.0) for k, ws in ((AUX, AUXILIARIES), (TARGET, TARGETS), (SUBJECT, SUBJECTS), (NOT, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in ws}


@dataclass
class Transducer:
    """Deterministic transducer over symbols: ``arcs[state, symbol]`` is (next state, factor); other symbols stay with factor 1."""

    states: int
    arcs: dict = field(default_factory=dict)

    def step(self, state: int, symbol: int) -> tuple[int, float]:
        return self.arcs.get((state, symbol), (state, 1.0))


def compose(parts: list[Transducer]) -> dict:
    """Arcs of the machine that runs all parts at once: (states, symbol) -> (states, product of the factors)."""
    out = {}
    for states in product(*(range(p.states) for p in parts)):
        for symbol in SYMBOLS:
            moves = [p.step(s, symbol) for p, s in zip(parts, states)]
            out[states, symbol] = (tuple(m[0] for m in moves), float(np.prod([m[1] for m in moves])))
    return out


# fixed values: weights of arcs before any is learned
FACTORS = {"row": 1.1, "after_threat": 1.3, "addressed": 1.5, "threatened": 1.0, "negated": 0.4, "reported": 0.6}
# fixed values: weights that learning may choose for an arc; those that weaken stay at 1 or below, those that strengthen at 1 or above
CHOICES = {"row": (1.0, 1.1, 1.5, 2.0), "after_threat": (1.0, 1.3, 2.0), "addressed": (1.0, 1.5, 2.0, 3.0), "threatened": (0.5, 1.0, 2.0), "negated": (0.0, 0.2, 0.4, 0.7, 1.0), "reported": (0.0, 0.3, 0.6, 0.8, 1.0)}
GAIN = 2.0  # log-likelihood that another weight of an arc must gain


def grammar_of(f: dict) -> dict:
    """The composed machine with arc weights ``f``. A factor is paid when an insult or threat is read in that state."""
    return compose([
        Transducer(2, {(0, INSULT): (1, 1.0), (1, INSULT): (1, f["row"])}),  # insults in a row
        Transducer(2, {(0, THREAT): (1, 1.0), (1, INSULT): (1, f["after_threat"])}),  # an insult after a threat
        # somebody is addressed (2); a subject (1) becomes that with the next word, unless this is a threat, whose doer it is
        Transducer(3, {(0, SUBJECT): (1, 1.0), **{(s, TARGET): (2, 1.0) for s in (0, 1)}, (1, OTHER): (2, 1.0), (1, REPORT): (0, 1.0), (1, THREAT): (0, 1.0), **{(s, INSULT): (2, f["addressed"]) for s in (1, 2)}}),
        Transducer(4, {(0, NOT): (1, 1.0), **{(s, x): ((s + 1) % 4, 1.0) for s in (1, 2, 3) for x in (OTHER, AUX)}, **{(s, x): (0, f["negated"]) for s in (1, 2, 3) for x in (INSULT, THREAT)}}),  # a negation reaches three words
        Transducer(2, {(0, REPORT): (1, 1.0), (1, INSULT): (1, f["reported"]), (1, THREAT): (1, f["reported"])}),  # reported speech
    ])


START = (0,) * 5


def weigh(clause: list[tuple[int, float]], grammar: dict, threatened: float) -> float:
    """Weight paid by one clause. A threat read before any target waits, with the factors of its place, for the first target after it.

    A subject ends the wait only when it is not the doer of another threat.
    """
    state, total, waiting, doer = START, 0.0, 0.0, False
    for symbol, weight in clause:
        addressed = state[2] == 2
        state, factor = grammar[state, symbol]
        if doer and symbol in (OTHER, TARGET, INSULT):
            total, waiting = total + waiting, 0.0
        doer = symbol == SUBJECT or doer and symbol in (AUX, NOT)
        if symbol == INSULT:
            total += weight * factor
        elif symbol == THREAT:
            if addressed:
                total += threatened * weight * factor
            else:
                waiting += threatened * weight * factor
        elif symbol == TARGET:
            total, waiting = total + waiting, 0.0
    return total + waiting if doer else total


@dataclass
class Grammar:
    """Lexicon: word, or prefix with a star, to weight. ``coef``: intercept and slopes of the logistic. ``factors``: weights of the arcs."""

    lexicon: dict
    coef: np.ndarray
    factors: dict = field(default_factory=lambda: dict(FACTORS))
    known: dict = field(default_factory=dict)

    def __post_init__(self):
        self.grammar = grammar_of(self.factors)

    def symbol(self, word: str) -> tuple[int, float]:
        got = self.known.get(word)
        if got is None:
            weight = max((self.lexicon.get(k, 0.0) for k in (word, *(word[:n] + "*" for n in PREFIXES if len(word) > n))), default=0.0)
            got = (INSULT, weight) if weight > 0 else FIXED.get(word, (OTHER, 0.0))
            if len(self.known) < 1_000_000:
                self.known[word] = got
        return got

    def read(self, text: str) -> tuple[list[list[tuple[int, float]]], int]:
        """Symbols of the clauses that hold an insult or a threat, and the number of words."""
        out, clause, words, hot = [], [], 0, False
        for token in TOKEN.findall(text.lower()):
            if token[0] in ".!?;:\n":
                if hot:
                    out.append(clause)
                clause, hot = [], False
                continue
            words += 1
            s = self.symbol(token)
            clause.append(s)
            if s[0] == INSULT or s[0] == THREAT:
                hot = True
        if hot:
            out.append(clause)
        return out, words

    def clauses(self, text: str) -> tuple[list[float], int]:
        """Weights of the clauses that hold an insult or a threat, and the number of words."""
        got, words = self.read(text)
        return [weigh(c, self.grammar, self.factors["threatened"]) for c in got], words

    def features(self, texts: list[str]) -> np.ndarray:
        return np.array([of_weights(*self.clauses(t)) for t in texts]).reshape(-1, 4)

    def score(self, texts: list[str]) -> np.ndarray:
        z = self.coef[0] + self.features(texts) @ self.coef[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def of_weights(w: list[float], n: int) -> tuple[float, float, float, float]:
    """Features of a document of ``n`` words from the weights of its clauses; a clause that pays nothing counts for nothing."""
    total = sum(w)
    return (np.log1p(total), max(w), np.log1p(sum(x > 0 for x in w)), 100 * total / (n + 20)) if total > 0 else (0.0, 0.0, 0.0, 0.0)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Intercept and slopes by Newton's method. Without both labels: the intercept of their share, and slopes of 1 for weights."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    if len(np.unique(y)) < 2:
        return np.array([np.log(share / (1 - share)) if len(y) else -3.0, 1.0, 1.0, 0.0, 0.0])
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    w[0] = np.log(share / (1 - share))
    pull = np.diag([1e-6, *[ridge * len(y) / 100 + 1e-3] * x.shape[1]])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        move = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + pull, a.T @ (y - p) - pull @ w)
        w += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-6:
            break
    return w


def likelihood(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    z = np.clip(w[0] + x @ w[1:], -30, 30)
    return float((y * z - np.logaddexp(0, z)).sum())


def learn_factors(read: list[tuple[list, int]], y: np.ndarray, rounds: int = 2) -> tuple[dict, np.ndarray]:
    """Arc weights, and the logistic that goes with them, from the clauses of labelled documents.

    One arc after another takes the weight of ``CHOICES`` under which the documents' labels are likeliest; it stays as it
    is unless that gains ``GAIN``, so arcs that no clause of the sample uses keep their first weight.
    """

    def fitted(f):
        grammar = grammar_of(f)
        x = np.array([of_weights([weigh(c, grammar, f["threatened"]) for c in clauses], n) for clauses, n in read]).reshape(-1, 4)
        w = fit_logistic(x, y)
        return likelihood(x, y, w), w

    best, (level, coef) = dict(FACTORS), fitted(FACTORS)
    if len(np.unique(y)) < 2:
        return best, coef
    for _ in range(rounds):
        before = dict(best)
        for arc, choices in CHOICES.items():
            for value in choices:
                if value != best[arc]:
                    tried, w = fitted(best | {arc: value})
                    if tried > level + GAIN:
                        best, level, coef = best | {arc: value}, tried, w
        if best == before:
            break
    return best, coef


def _one_of_copies(sample: DataFrame) -> DataFrame:
    """Rows of the sample without near copies: a row goes when a smaller id shares one of four minima of its shingles' hashes."""

    def rows(batches):
        for b in batches:
            texts = b["text"].fillna("").tolist()
            h, at = shingles(texts, 5)
            keys = np.zeros((4, len(texts)), np.uint64)
            if len(h):
                start = np.searchsorted(at, np.unique(at))
                for k in range(4):
                    keys[k, np.unique(at)] = np.minimum.reduceat(mix(h + np.uint64(k + 1)), start)
            yield pd.concat([pd.DataFrame({"doc_id": b["doc_id"], "k": k, "low": keys[k].view(np.int64)}) for k in range(4)])

    keys = sample.select("doc_id", "text").mapInPandas(rows, "doc_id long, k int, low long")
    first = keys.groupBy("k", "low").agg(F.min("doc_id").alias("first"))
    gone = keys.join(first, ["k", "low"]).filter("doc_id > first").select("doc_id").distinct()
    return sample.join(gone, "doc_id", "left_anti")


def learn_lexicon(sample: DataFrame, least: float = 18.0, entries: int = ENTRIES) -> dict:
    """Words and prefixes that speak for label 1: log-odds of their documents, where the log-likelihood ratio reaches ``least``.

    A prefix counts without the documents of its most frequent word, so one word makes no family. ``sample``: text and _y. Counting is done in Spark; the ``entries`` strongest reach the driver. The seed words are
    in the lexicon with weight 1 at least.
    """

    def rows(batches):
        for b in batches:
            for text, y in zip(b["text"].fillna("").tolist(), b["_y"].tolist()):
                words = {w for w in TOKEN.findall(text.lower()) if w[0] not in ".!?;:\n"}
                keys = words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}
                yield pd.DataFrame({"key": list(keys), "pos": int(y), "neg": 1 - int(y)}, columns=["key", "pos", "neg"])

    n1, n0 = sample.agg(F.coalesce(F.sum("_y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("_y")), F.lit(0))).first()
    lexicon = {w: 1.0 for w in INSULTS}
    if not n1 or not n0:
        return lexicon
    counts = sample.mapInPandas(rows, "key string, pos long, neg long").groupBy("key").agg(F.sum("pos").alias("a"), F.sum("neg").alias("b")).filter("a >= 2")
    counts = counts.persist()
    word = counts.filter(~F.col("key").endswith("*"))
    most = word.select(F.explode(F.array(*[F.concat(F.substring("key", 1, n), F.lit("*")) for n in PREFIXES])).alias("key"), F.col("a").alias("top")).groupBy("key").agg(F.max("top").alias("top"))
    family = counts.filter(F.col("key").endswith("*")).join(most, "key").select("key", (F.col("a") - F.col("top")).alias("a"), "b")
    counted, counts = counts, word.select("key", "a", "b").union(family).filter("a >= 3")
    rate = n1 / (n1 + n0)
    mean = (F.col("a") + F.col("b")) * rate
    ratio = 2 * (F.col("a") * F.log(F.col("a") / mean) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (F.col("a") + F.col("b") - mean))).otherwise(0.0))
    odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    top = counts.withColumns({"ratio": ratio, "odds": odds}).filter((F.col("ratio") >= least) & (F.col("odds") >= 2)).orderBy(F.desc("ratio"), "key").limit(entries).collect()
    counted.unpersist()
    for r in top:
        lexicon[r["key"]] = max(lexicon.get(r["key"], 0.0), min(r["odds"], 6.0) / 4)
    return lexicon


def fit_documents(docs: DataFrame, labels: DataFrame, label: str = "toxic", train="true", bound: int = FIT_ROWS) -> Grammar:
    """Lexicon, arc weights and logistic from at most about ``bound`` labelled rows, near copies counted once. Only counts and the symbols of clauses with an insult or threat reach the driver."""
    sample = _one_of_copies(labelled_sample(docs, labels, label, train, bound)).select("text", F.col("_y").cast("long").alias("_y"))
    sample = sample.persist()
    g = Grammar(learn_lexicon(sample), np.zeros(5))

    def rows(batches):
        for b in batches:
            got = [g.read(t) for t in b["text"].fillna("").tolist()]
            flat = [[v for c in clauses for v in (*[x for pair in c for x in pair], -1.0)] for clauses, _ in got]
            yield pd.DataFrame({"c": flat, "n": [n for _, n in got], "y": b["_y"].astype("float64")})

    got = sample.mapInPandas(rows, "c array<double>, n long, y double").collect()
    sample.unpersist()
    got = sorted((list(r["c"]), r["n"], r["y"]) for r in got)
    factors, coef = learn_factors([(_unflatten(c), n) for c, n, _ in got], np.array([y for _, _, y in got]))
    return Grammar(g.lexicon, coef, factors)


def _unflatten(flat: list[float]) -> list[list[tuple[int, float]]]:
    """Clauses of (symbol, weight) from a row of symbols and weights in turn, -1 after each clause."""
    out, clause, i = [], [], 0
    while i < len(flat):
        if flat[i] < 0:
            out.append(clause)
            clause, i = [], i + 1
        else:
            clause.append((int(flat[i]), flat[i + 1]))
            i += 2
    return out


def score_documents(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """The rows of ``docs`` with ``score`` (replaced if there); a null text scores as an empty one, each row by its own text whatever its id."""
    lexicon, coef, factors = grammar.lexicon, grammar.coef, grammar.factors

    def scores(parts):
        g = Grammar(lexicon, coef, factors)
        for text in parts:
            yield pd.Series(g.score(text.fillna("").tolist()), dtype="float64")

    from collections.abc import Iterator

    scores.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn("score", F.pandas_udf(scores, "double")("text"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    grammar = fit_documents(docs, labels, "toxic", ~held_out(4, 2))
    scored = score_documents(docs.select("doc_id", "text"), grammar)
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
