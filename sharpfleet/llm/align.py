"""Alignment of the tokens of two tokenizers over the same bytes, and how strongly the corpus links their ids.

Side A is a byte-level vocabulary (JSON), side B a piece model with byte fallback. Both sides cut the bytes of a blank
and the text. Within a task, two as-of joins keyed by document find for each token start the other side's covering
token; their union holds every overlap, and overlaps whose ends agree cut a text into groups and are its links.
A text is encoded once: its distinct linked pairs are kept with their counts, pair counts are summed over the corpus,
and a last pass looks them up.
"""

from __future__ import annotations

import hashlib
import json
import sys
import types
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sharpfleet.llm.store import Store

CHUNK = 500_000  # characters that are aligned at a time; a longer text is a chunk of its own
SPAN = 1 << 15  # pair code = id of A * SPAN + id of B


def byte_of_mark() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Sides:
    """Both tokenizers, the bytes of their ids, and the decimal digits of ids."""

    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        marks = byte_of_mark()
        ranks = {bytes(marks[c] for c in token): i for token, i in model["vocab"].items()}
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if [model["vocab"][m] for m in made] != list(range(256, 256 + len(made))):
            raise ValueError(f"{a_path}: ids are not in the order of the merges")
        self.a = tiktoken.Encoding("side_a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [x for x, _ in sorted(ranks.items(), key=lambda e: e[1])]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if len(self.b_bytes) > SPAN or len(self.a_bytes) * SPAN > 1 << 31:
            raise ValueError("pair codes do not fit 31 bits")
        self.a_size, self.b_size = (np.array([len(x) for x in s], np.int64) for s in (self.a_bytes, self.b_bytes))
        numbers = np.arange(max(len(self.a_bytes), len(self.b_bytes)))
        self.width = np.char.str_len(numbers.astype(str))
        self.digits = np.zeros((len(numbers), self.width.max() + 1), np.uint8)
        for i in numbers:
            self.digits[i, : self.width[i]] = np.frombuffer(str(i).encode(), np.uint8)

    @classmethod
    def kept(cls, a_path: str, b_path: str) -> Sides:
        """Loaded once per Python process."""
        store = sys.modules.setdefault("_sharpfleet_kept", types.ModuleType("_sharpfleet_kept")).__dict__
        key = ("sides", a_path, b_path)
        if key not in store:
            store[key] = cls(a_path, b_path)
        return store[key]

    def most_pairs(self) -> int:
        """More different pairs can't be linked: of two tokens that end together one's bytes end the other's."""
        ends = {}
        for side in (self.a_bytes, self.b_bytes):
            own = {}
            for x in side:
                own[x] = own.get(x, 0) + 1
            ends[len(ends)] = own
        return sum(ends[1 - i].get(x[k:], 0) for i, side in enumerate((self.a_bytes, self.b_bytes)) for x in side for k in range(len(x)))

    def encode(self, texts: list) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides; none where the text is null or empty or a side does not give its bytes back."""
        no_ids, whole = np.zeros(0, np.int64), [t for t in texts if t]
        pieces, a, b = iter(self.b.encode(whole, num_threads=1) if whole else []), [], []
        for t in texts:
            x, y = (self.a.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int64), next(pieces)) if t else (no_ids, [])
            raw = (" " + t).encode() if t else b""
            same = b"".join([self.a_bytes[i] for i in x.tolist()]) == raw == b"".join([self.b_bytes[i] for i in y])
            a.append(x if same else no_ids)
            b.append(np.array(y, np.int64) if same else no_ids)
        return a, b


@dataclass
class Alignment:
    """Tokens of several texts one after another. Byte positions run through all of them, so texts never touch."""

    a: np.ndarray  # ids
    b: np.ndarray
    a_doc: np.ndarray  # text of each token
    b_doc: np.ndarray
    a_end: np.ndarray  # byte position after each token
    b_end: np.ndarray
    over_a: np.ndarray  # overlaps: token of A, token of B
    over_b: np.ndarray
    linked: np.ndarray  # overlaps that end together


def align_texts(sides: Sides, texts: list) -> Alignment:
    a, b = sides.encode(texts)
    n = np.arange(len(texts))
    a_doc, b_doc = np.repeat(n, [len(x) for x in a]), np.repeat(n, [len(x) for x in b])
    none = [np.zeros(0, np.int64)]
    a, b = np.concatenate(a + none), np.concatenate(b + none)
    a_end, b_end = np.cumsum(sides.a_size[a]), np.cumsum(sides.b_size[b])
    left = pd.DataFrame({"start": a_end - sides.a_size[a], "doc": a_doc, "a": np.arange(len(a))})
    right = pd.DataFrame({"start": b_end - sides.b_size[b], "doc": b_doc, "b": np.arange(len(b))})
    from_a = pd.merge_asof(left, right, on="start", by="doc")[["a", "b"]].to_numpy()
    from_b = pd.merge_asof(right, left, on="start", by="doc")[["a", "b"]].to_numpy()
    new = left["start"].to_numpy()[from_b[:, 0]] < right["start"].to_numpy()[from_b[:, 1]]  # equal starts were found before
    over = np.concatenate([from_a, from_b[new]])
    return Alignment(a, b, a_doc, b_doc, a_end, b_end, over[:, 0], over[:, 1], a_end[over[:, 0]] == b_end[over[:, 1]])


def group_texts(sides: Sides, m: Alignment, n_docs: int) -> list[bytes]:
    """Groups of each text: ids of A, then those of B, as `a1,a2|b1;a3|b2,b3`."""
    a_last, b_last = np.zeros(len(m.a), bool), np.zeros(len(m.b), bool)
    a_last[m.over_a[m.linked]] = True
    b_last[m.over_b[m.linked]] = True
    a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    n_groups = int(a_last.sum())
    a_n, b_n = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
    a_at = np.arange(len(m.a)) + (np.cumsum(b_n) - b_n)[a_group]
    b_at = np.arange(len(m.b)) + np.cumsum(a_n)[b_group]
    ids, mark = np.zeros(len(m.a) + len(m.b), np.int64), np.zeros(len(m.a) + len(m.b), np.uint8)
    ids[a_at], ids[b_at] = m.a, m.b
    mark[a_at], mark[b_at] = np.where(a_last, ord("|"), ord(",")), np.where(b_last, ord(";"), ord(","))
    width = sides.width[ids]
    cells = sides.digits[ids]
    cells[np.arange(len(ids)), width] = mark
    flat = cells[np.arange(cells.shape[1]) <= width[:, None]].tobytes()
    tokens = np.bincount(m.a_doc, minlength=n_docs) + np.bincount(m.b_doc, minlength=n_docs)
    ends = np.concatenate([[0], np.cumsum(width + 1)])[np.cumsum(tokens)]
    return [flat[s : max(s, e - 1)] for s, e in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist())]


def chunks(frames):
    """(ids, texts) of bounded length from the batches of a task."""
    for frame in frames:
        ids = frame["doc_id"].astype(object).where(frame["doc_id"].notna(), None).tolist()
        texts = [t if isinstance(t, str) else None for t in frame["text"].tolist()]
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= CHUNK or i + 1 == len(texts):
                yield ids[start : i + 1], texts[start : i + 1]
                start, size = i + 1, 0


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The alignment itself, one row per row of ``docs``: doc_id, ids ``a`` and ``b``, overlaps as places (``over_a``, ``over_b``)
    in these lists, and the byte offsets where both sides end (``ends``; the blank before the text has offset 0).

    Null and empty texts, and texts whose tokens do not give back a blank and the text, have empty lists. Rows that
    repeat, or have no id, are aligned one by one. Other columns are not read.
    """

    def run(frames):
        sides = Sides.kept(a_path, b_path)
        for ids, texts in chunks(frames):
            m, out = align_texts(sides, texts), []
            first = [np.searchsorted(d, np.arange(len(texts) + 1)) for d in (m.a_doc, m.b_doc)]
            order = np.lexsort((m.over_b, m.over_a))
            over_a, over_b, linked = m.over_a[order], m.over_b[order], m.linked[order]
            cut = np.searchsorted(m.a_doc[over_a], np.arange(len(texts) + 1))
            for i, key in enumerate(ids):
                (a0, a1), (b0, b1), (o0, o1) = (x[i : i + 2] for x in (*first, cut))
                base = m.a_end[a0 - 1] if a0 else 0
                ends = m.a_end[over_a[o0:o1][linked[o0:o1]]] - base
                out.append((key, m.a[a0:a1], m.b[b0:b1], over_a[o0:o1] - a0, over_b[o0:o1] - b0, ends))
            yield pd.DataFrame(out, columns=["doc_id", "a", "b", "over_a", "over_b", "ends"]).astype({"doc_id": "Int64"})

    schema = "doc_id long, a array<int>, b array<int>, over_a array<int>, over_b array<int>, ends array<long>"
    return docs.select("doc_id", "text").mapInPandas(run, schema)


DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string"


def digest(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Figures of each row's alignment and its distinct linked pairs (``codes``, sorted, with ``times``; little-endian 32-bit)."""

    def run(frames):
        sides = Sides.kept(a_path, b_path)
        for ids, texts in chunks(frames):
            m, n = align_texts(sides, texts), len(texts)
            groups = group_texts(sides, m, n)
            doc = m.a_doc[m.over_a]
            key = (doc[m.linked] << 31) | (m.a[m.over_a[m.linked]] * SPAN + m.b[m.over_b[m.linked]])
            key, times = np.unique(key, return_counts=True)
            cut = np.searchsorted(key >> 31, np.arange(n + 1)).tolist()
            code, times = (key & 0x7FFFFFFF).astype("<i4"), times.astype("<i4")
            links = np.bincount(doc[m.linked], minlength=n)
            yield pd.DataFrame({
                "doc_id": pd.array(ids, "Int64"),
                "n_a": np.bincount(m.a_doc, minlength=n), "n_b": np.bincount(m.b_doc, minlength=n),
                "n_groups": [g.count(b"|") for g in groups], "n_links": links, "n_overlaps": np.bincount(doc, minlength=n),
                "groups_sha256": [hashlib.sha256(g).hexdigest() if g else "" for g in groups],
                "codes": [code[s:e].tobytes() for s, e in zip(cut, cut[1:])],
                "times": [times[s:e].tobytes() for s, e in zip(cut, cut[1:])],
            })

    return docs.select("doc_id", "text").mapInPandas(run, DIGEST + ", codes binary, times binary")


def pair_counts(digests: DataFrame) -> DataFrame:
    """(a, b, n, best): links of the corpus that hold the pair, and whether no other pair of its id of B has more.

    Each task sums its pairs before the shuffle. The table is bounded by the vocabularies (``Sides.most_pairs``).
    """

    def summed(codes, times):
        code, place = np.unique(codes, return_inverse=True)
        return code, np.bincount(place, times, len(code)).astype(np.int64)

    def run(frames):
        code, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for f in frames:
            more = summed(np.frombuffer(b"".join(f["codes"]), "<i4"), np.frombuffer(b"".join(f["times"]), "<i4"))
            code, n = summed(np.concatenate([code, more[0]]), np.concatenate([n, more[1]]))
        yield pd.DataFrame({"code": code, "n": n})

    pairs = digests.select("codes", "times").mapInPandas(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    pairs = pairs.select((F.col("code") / SPAN).cast("int").alias("a"), (F.col("code") % SPAN).cast("int").alias("b"), "n")
    return pairs.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def with_corpus_counts(digests: DataFrame, pairs: DataFrame) -> DataFrame:
    """``n_best`` and ``count_sum`` of each row. The pairs of the corpus, bounded by the vocabularies, go to every executor."""
    table = pairs.select("a", "b", "n", "best").toPandas()
    code = table["a"].to_numpy(np.int64) * SPAN + table["b"].to_numpy(np.int64)
    order = np.argsort(code)
    held = digests.sparkSession.sparkContext.broadcast((code[order], table["n"].to_numpy(np.int64)[order], table["best"].to_numpy(bool)[order]))

    def run(frames):
        code, n, best = held.value
        for f in frames:
            own, times = np.frombuffer(b"".join(f["codes"]), "<i4"), np.frombuffer(b"".join(f["times"]), "<i4").astype(np.int64)
            at = np.searchsorted(code, own)
            row = np.repeat(np.arange(len(f)), [len(x) // 4 for x in f["codes"]])
            total, top = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            np.add.at(total, row, times * n[at])
            np.add.at(top, row, times * best[at])
            out = f.drop(columns=["codes", "times"])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"), n_best=top, count_sum=total)

    return digests.mapInPandas(run, DIGEST + ", n_best long, count_sum long")


def align_corpus(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per row of ``docs``: figures of its alignment, and of how the corpus links its pairs (see the contract of op11).

    Links are the overlaps that end together, so a text has as many as groups. Null and empty texts and texts that a
    side does not give back have zeros and an empty ``groups_sha256``; they add nothing to the counts. Rows that repeat
    or have no id count each for itself; an empty table gives an empty one; other columns are not read.
    """
    store = Store(docs.sparkSession)
    digests = store.put(digest(docs, a_path, b_path), "digests")
    pairs = store.put(pair_counts(digests), "pairs")
    return with_corpus_counts(digests, pairs)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = align_corpus(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")
