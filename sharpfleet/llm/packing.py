"""Packing of tokenized documents into sequences of one length.

Documents are cut into pieces of a full sequence and a rest. Rests and full pieces are dealt into random groups of
bounded size; within a group, first-fit decreasing places the rests, finding the first open sequence with enough room
in a tournament tree of capacities, and pieces of the emptiest sequences are cut to fill the gaps of the fullest.
"""

from __future__ import annotations

import base64
import sys
import types
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LENGTH = 1024
GROUP = 2048  # documents of a group, on average
LEAST = 8  # no shorter fragment is cut to fill a gap

SPECIAL = {"<|endoftext|>": 50256}


def encoder(path: str):
    """The byte-level tokenizer whose ranks are in the file; loaded once per Python process."""
    import public_tokenizers
    import tiktoken

    kept = sys.modules.setdefault("_sharpfleet_kept", types.ModuleType("_sharpfleet_kept")).__dict__
    if path not in kept:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        kept[path] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return kept[path]


class Tournament:
    """Complete binary tree over bins; each node knows the largest room below it."""

    def __init__(self, bins: int, room: int):
        self.size = 1
        while self.size < bins:
            self.size *= 2
        self.room = [room] * (2 * self.size)

    def first(self, need: int) -> int:
        """The first bin with room for ``need``; every bin has room when it is unused, so one exists."""
        room, i = self.room, 1
        while i < self.size:
            i *= 2
            if room[i] < need:
                i += 1
        return i - self.size

    def take(self, bin_: int, need: int) -> None:
        room, i = self.room, bin_ + self.size
        room[i] -= need
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])


def first_fit_decreasing(sizes: list[int], length: int) -> list[int]:
    """Bin of each size; ``sizes`` are tried from the largest to the smallest, equal ones in the given order."""
    out = [0] * len(sizes)
    tree = Tournament(len(sizes), length)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out[i] = tree.first(sizes[i])
        tree.take(out[i], sizes[i])
    return out


def fill_gaps(bins: list[list[tuple[int, int, int]]], length: int, least: int) -> list[list[tuple[int, int, int]]]:
    """Cut pieces (document, start, size) of the emptiest bins into the gaps of the fullest, until one bin with a gap remains.

    Gaps below ``least`` stay; so do bins that need no padding (a power of two).
    """
    used = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda i: -used[i])
    give = len(order) - 1
    for at, i in enumerate(order):
        while at < give and length - used[i] >= least and used[i] & (used[i] - 1):
            source = order[give]
            if not bins[source]:
                give -= 1
                continue
            doc, start, size = bins[source].pop()
            part = min(size, length - used[i])
            bins[i].append((doc, start, part))
            used[i] += part
            used[source] -= part
            if part < size:
                bins[source].append((doc, start + part, size - part))
    return [b for b in bins if b]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, group: int = GROUP, least: int = LEAST, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their place in a sequence; ``with_ids`` adds the token ids.

    A document's ids are those of its text and then 0; a null text counts as empty. Every id is in exactly one piece,
    offsets in a sequence run from 0 without gaps. ``tokenizer`` is the path of a file of byte-level ranks that every
    executor has.
    """
    n_groups = max(1, -(-docs.count() // group))

    def cut(batches):
        code = encoder(tokenizer)
        for b in batches:
            for text, key in zip(b["text"].fillna("").tolist(), b["doc_id"].astype(object).where(b["doc_id"].notna(), None).tolist()):
                ids = np.array(code.encode(text, allowed_special="all") + [0], np.uint16)
                full = len(ids) // length
                rows = [(key, k * length, length, zlib.crc32(ids[k * length : (k + 1) * length].astype("<u4").tobytes()), ids[k * length : (k + 1) * length].tobytes() if with_ids else None) for k in range(full)]
                if len(ids) > full * length:
                    rows.append((key, full * length, len(ids) - full * length, None, ids[full * length :].tobytes()))
                for row in rows:
                    yield (zlib.crc32(f"{key}:{row[1]}".encode()) % n_groups, len(ids), *row)

    def cut_batches(batches):
        names, rows, total = ["grp", "doc_tokens", "doc_id", "start", "length", "crc", "ids"], [], 0
        for row in cut(batches):
            rows.append(row)
            total += row[4]
            if total > 2_000_000:
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "crc": "Int64"})
                rows, total = [], 0
        yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "crc": "Int64"})

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start"], kind="stable", na_position="first").reset_index(drop=True)
        keys = rows["doc_id"].astype(object).where(rows["doc_id"].notna(), None).tolist()
        starts, sizes, blobs, whole, tokens = (rows[c].tolist() for c in ("start", "length", "ids", "crc", "doc_tokens"))
        done = rows["crc"].notna().tolist()
        rest = [i for i in range(len(rows)) if not done[i]]
        bins = [[] for _ in rest]
        for i, b in zip(rest, first_fit_decreasing([sizes[i] for i in rest], length)):
            bins[b].append((i, 0, sizes[i]))
        bins = fill_gaps([b for b in bins if b], length, least) + [[(i, 0, length)] for i in range(len(rows)) if done[i]]
        out, base = [], int(rows["grp"].iloc[0]) << 32
        for n, b in enumerate(bins):
            offset = 0
            for i, start, size in b:
                ids = None if blobs[i] is None else np.frombuffer(blobs[i], np.uint16)[start : start + size]
                crc = int(whole[i]) if done[i] else zlib.crc32(ids.astype("<u4").tobytes())
                out.append((keys[i], starts[i] + start, size, crc, tokens[i], base + n, offset, *([ids.astype(np.int32)] if with_ids else [])))
                offset += size
        return pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")]).astype({"doc_id": "Int64"})

    schema = PIECES + (", ids array<int>" if with_ids else "")
    pieces = docs.select("doc_id", "text").mapInPandas(cut_batches, "grp long, doc_tokens long, doc_id long, start long, length long, crc long, ids binary")
    return pieces.groupBy("grp").applyInPandas(place, schema)


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=False)
