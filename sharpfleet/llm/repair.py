"""Repair of the structure of conversations by weighted interval parsing (CYK).

The roles that a repaired conversation may have, ``(s?(ua)+)?``, are a grammar in Chomsky normal form whose nonterminals
stand for "from one point of the pattern to another": a span of rows derives (p, q) from (p, r) and (r, q), a single row
derives what its edits (Delete, Keep, Rerole) give, and insertions close every row's cell. Each cell holds the least
(cost, audit); spans are joined bottom-up by length. In this grammar every split of a span gives the same cell, so the
spans of doubling length are enough, and a conversation that lies in several partitions is joined from its parts.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sharpfleet.llm.store import Store

BLANK = " \t\n\x0b\x0c\r"

# Costs of edits, points of the pattern (Begin, after System, after User, after Assistant), accepted spans.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
STEP = {("B", "s"): "S", ("B", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
ACCEPTED = ("BB", "BA")


def grammar() -> tuple[list[str], list[tuple[int, int, int]]]:
    """Nonterminals (pairs of points that a role path links) and binary rules (whole, left, right) as places among them."""
    reach = {p: {p} for p in "BSUA"}
    for _ in reach:
        for (p, _role), q in STEP.items():
            reach[p] |= reach[q]
    names = [p + q for p in "BSUA" for q in "BSUA" if q in reach[p]]
    at = {n: i for i, n in enumerate(names)}
    return names, [(at[p + q], at[p + r], at[r + q]) for p, q in names for r in "BSUA" if p + r in at and r + q in at]


NAMES, RULES = grammar()


def join(left: list, right: list) -> list:
    """Cell of two neighbouring spans. Audits of one span and cost differ before either ends, so least parts give the least whole."""
    out = [None] * len(NAMES)
    for whole, a, b in RULES:
        if left[a] is not None and right[b] is not None:
            new = (left[a][0] + right[b][0], left[a][1] + right[b][1])
            if out[whole] is None or new < out[whole]:
                out[whole] = new
    return out


def no_rows() -> list:
    """Cell of an empty span: nothing, or insertions of user and assistant."""
    one = [(0, "") if p == q else (INSERT, "I") if any(STEP.get((p, r)) == q for r in "ua") else None for p, q in NAMES]
    while (more := join(one, one)) != one:
        one = more
    return one


def rows_of_class() -> dict[str, list]:
    """Cell of a single row by class: its role's initial (o: none of the pattern's), a capital if truncated; x: must go."""
    cells, empty = {}, no_rows()
    for kind in "suaoSUAOx":
        more, base = TRUNCATED if kind.isupper() else 0, {p + p: (DELETE, "D") for p in "BSUA"}
        for (p, role), q in STEP.items() if kind != "x" else ():
            edits = [(more, "K")] if role == kind.lower() else []
            edits += [(more + REROLE, "R")] if role in "ua" else []
            for e in edits:
                base[p + q] = min(base.get(p + q, e), e)
        cells[kind] = join(join(empty, [base.get(n) for n in NAMES]), empty)
    return cells


def joined(cells: list[list]) -> list:
    """Cell of all: neighbouring spans are joined until one is left."""
    if not cells:
        return no_rows()
    while len(cells) > 1:
        cells = [join(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def best(cell: list) -> tuple[int, str]:
    return min(cell[NAMES.index(n)] for n in ACCEPTED if cell[NAMES.index(n)] is not None)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of rows harmed by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its text, 2 removes
    its sentence ends, 3 repeats it, 4 makes it the user's. Nulls are one blank, in the key as in role and text."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    d = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    d = d.withColumns({"role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")), "text": text})
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return d.filter("kind <> 0").withColumn("_time", F.explode(times)).select("conv_id", "turn", "role", "text")


def _ordered() -> list[Column]:
    """Order of rows within a conversation: by turn (nulls first), rows of one turn by role and then by hash of the text."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("h")]


def _plain(turns: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("h"))


def facts(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct rows of every conversation, without texts: ``n`` copies, ``blank``, ``again`` (role and text stand in an earlier turn),
    ``cut`` (truncated). Conversations of ``ids`` have one more row without copies."""
    bare = F.btrim("text", F.lit(BLANK))
    d = _plain(turns).select("conv_id", "turn", "role", "h", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    d = d.groupBy("conv_id", "turn", "role", "h").agg(F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    first = d.groupBy("conv_id", "role", "h").agg(F.min(F.struct(F.col("turn").isNotNull().alias("set"), "turn")).alias("_first"))
    at = F.struct(F.col("turn").isNotNull().alias("set"), "turn")
    on = F.col("d.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("d.role") == F.col("f.role")) & (F.col("d.h") == F.col("f.h"))
    d = d.withColumn("_at", at).alias("d").join(first.alias("f"), on).select("d.*", (F.col("_at") > F.col("_first")).alias("again")).drop("_at")
    none = ids.select("conv_id").distinct().selectExpr(
        "conv_id", "CAST(NULL AS LONG) turn", "'' role", "CAST('' AS BINARY) h", "0L n", "false blank", "false cut", "false again")
    return d.unionByName(none)


PART = "conv_id string, part int, low long, high long, turns long, head string, tail string, blank long, duplicate long, truncated long, illegal long, costs array<long>, audits array<string>"
FAULTS = ["blank", "duplicate", "truncated", "illegal"]
EDITS = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _parts(frames):
    """Parses the rows of a sorted partition: one part for each conversation in it."""
    by_class, known = rows_of_class(), {}

    def parse(kinds):
        cells = []
        for i in range(0, len(kinds), 16):
            word = "".join(kinds[i : i + 16])
            if word not in known:
                if len(known) > 50_000:
                    known.clear()
                known[word] = joined([by_class[k] for k in word])
            cells.append(known[word])
        return joined(cells)

    def close(p, kinds):
        cell = parse(kinds)
        return {**p, "costs": [None if c is None else c[0] for c in cell], "audits": [None if c is None else c[1] for c in cell]}

    number, now, kinds, out = TaskContext.get().partitionId(), None, [], []
    for f in frames:
        for conv, turn, role, n, blank, cut, again in zip(*(f[c].tolist() for c in ("conv_id", "turn", "role", "n", "blank", "cut", "again"))):
            if now is None or now["conv_id"] != conv:
                if now is not None:
                    out.append(close(now, kinds))
                now, kinds = dict.fromkeys(FAULTS, 0) | {"conv_id": conv, "part": number, "low": None, "high": None, "turns": 0, "head": None, "tail": None}, []
            if not n:
                continue
            initial = role[:1]
            if turn is not None:
                turn = int(turn)
                now["turns"] += turn != now["high"]
                now["low"], now["high"] = turn if now["low"] is None else now["low"], turn
            now["illegal"] += (now["tail"] is not None and now["tail"] + initial not in ("su", "ua", "au")) + (n - 1 if initial + initial not in ("su", "ua", "au") else 0)
            now["head"], now["tail"] = initial if now["head"] is None else now["head"], initial
            gone = n if blank or again else n - 1
            now["blank" if blank else "duplicate"] += gone
            if gone < n:
                kind = initial if initial and initial in "sua" else "o"
                now["truncated"] += cut
                kinds.append(kind.upper() if cut else kind)
            kinds += "x" * gone
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PART.split(", ")]).astype({"low": "Int64", "high": "Int64"})
            out = []
    if now is not None:
        yield pd.DataFrame([close(now, kinds)], columns=[c.split()[0] for c in PART.split(", ")]).astype({"low": "Int64", "high": "Int64"})


def _whole(frames):
    """Joins the parts of each conversation, which come in order."""
    def close(parts):
        cell = joined([[None if a is None else (int(c), a) for c, a in zip(p["costs"], p["audits"])] for p in parts])
        total = {k: sum(p[k] for p in parts) for k in FAULTS}
        held = [p for p in parts if p["head"] is not None]
        total["illegal"] += sum(a["tail"] + b["head"] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        timed = [p for p in held if p["turns"]]
        turns = sum(p["turns"] for p in timed) - sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:]))
        gaps = int(timed[-1]["high"]) - int(timed[0]["low"]) + 1 - turns if timed else 0
        cost, audit = best(cell)
        return {"conv_id": parts[0]["conv_id"], "gaps": gaps, **total, "cost": cost, "audit": audit}

    names, parts, out = [c.split()[0] for c in EDITS.split(", ")], [], []
    for f in frames:
        for p in f.to_dict("records"):
            if parts and parts[0]["conv_id"] != p["conv_id"]:
                out.append(close(parts))
                parts = []
            parts.append(p)
        if out:
            yield pd.DataFrame(out, columns=names)
            out = []
    if parts:
        yield pd.DataFrame([close(parts)], columns=names)


def edits(turns: DataFrame, ids: DataFrame | None = None, store: Store | None = None) -> DataFrame:
    """One row per conversation: conv_id, ``gaps`` between turns, counts of faults, and the least ``cost`` with its ``audit``.

    Each row's first fault counts: blank, duplicate (role and text stand earlier), truncated. Blank and duplicate rows
    must be deleted. ``ids`` adds conversations that may have no row. Rows without conv_id are one conversation; null
    roles and texts count as one blank (a role without legal initial can't be kept); equal rows stay next to each other.
    """
    store = store or Store(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType
    d = store.put(facts(turns, turns if ids is None else ids), "facts")
    d = d.repartitionByRange(F.col("conv_id").asc_nulls_first(), *_ordered()).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *_ordered())
    d = d.select(F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "n", "blank", "cut", "again")
    parts = d.mapInPandas(_parts, PART).repartition("conv_id")
    parts = parts.withColumns({c: F.col(c).cast("string") for c in ("low", "high")}).sortWithinPartitions("conv_id", "part")
    return parts.mapInPandas(_whole, EDITS).withColumn("conv_id", F.col("conv_id").cast(kind))


def _rebuilt(frames):
    """Repaired rows of sorted conversations: (head, None), then (head, (role, text, edit, turn)) for each of its rows."""
    head = None
    for f in frames:
        for r in f.to_dict("records"):
            if r["audit"] is not None:
                if head:
                    yield from rest(head)
                head = {**r, "at": 0, "point": "B"}
                yield head, None
                continue
            yield from inserted(head)
            edit = head["audit"][head["at"]]
            head["at"] += 1
            if edit != "D":
                role = r["role"] if edit == "K" else _next_role(head["point"])
                head["point"] = STEP[head["point"], role[0]]
                yield head, (role, r["text"], edit, r["turn"])
    if head:
        yield from rest(head)


def _next_role(point: str) -> str:
    return "assistant" if point == "U" else "user"


def inserted(head: dict):
    while head["audit"][head["at"] : head["at"] + 1] == "I":
        role = _next_role(head["point"])
        head["at"], head["point"] = head["at"] + 1, STEP[head["point"], role[0]]
        yield head, (role, "", "I", None)


def rest(head: dict):
    yield from inserted(head)
    if head["at"] != len(head["audit"]):
        raise ValueError(f"conversation {head['conv_id']}: the audit does not fit its rows")


def _with_rows(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's edits followed by its rows, in one partition and in order. Only the text of one batch is held at a time."""
    h = found.select(F.lit(0).alias("place"), *found.columns)
    rows = _plain(turns).withColumn("place", F.lit(1))
    d = h.unionByName(rows, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "place", *_ordered())
    return d.withColumns({"conv_id": F.col("conv_id").cast("string"), "turn": F.col("turn").cast("string")}).drop("h", "place")


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of the repaired conversations: conv_id, ``place`` from 0, role, text, ``edit`` (K, R or I) and the ``turn`` a row had."""
    def run(frames):
        out, last, place = [], None, 0
        for head, row in _rebuilt(frames):
            if row is None:
                place = 0
                continue
            out.append((head["conv_id"], place, *row))
            place += 1
            if len(out) >= 4096:
                yield pd.DataFrame(out, columns=["conv_id", "place", "role", "text", "edit", "turn"])
                out = []
        yield pd.DataFrame(out, columns=["conv_id", "place", "role", "text", "edit", "turn"])

    d = _with_rows(turns, found).mapInPandas(run, "conv_id string, place long, role string, text string, edit string, turn string")
    return d.withColumns({"conv_id": F.col("conv_id").cast(turns.schema["conv_id"].dataType), "turn": F.col("turn").cast("long")})


def with_hash(turns: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` and the SHA-256 of each repaired conversation's `role:text`, joined by line feeds (of '' where no row is left)."""
    names = [c.split()[0] for c in EDITS.split(", ")]

    def run(frames):
        out, now, sha, any_ = [], None, None, False
        def close():
            return {**{k: now[k] for k in names}, "repaired_sha256": sha.hexdigest()}
        for head, row in _rebuilt(frames):
            if row is None:
                if now is not None:
                    out.append(close())
                now, sha, any_ = head, hashlib.sha256(), False
                if len(out) >= 4096:
                    yield pd.DataFrame(out)
                    out = []
            else:
                sha.update(("\n" if any_ else "").encode() + f"{row[0]}:{row[1]}".encode())
                any_ = True
        if now is not None:
            out.append(close())
        yield pd.DataFrame(out, columns=[*names, "repaired_sha256"])

    d = _with_rows(turns, found).mapInPandas(run, EDITS + ", repaired_sha256 string")
    return d.withColumn("conv_id", F.col("conv_id").cast(turns.schema["conv_id"].dataType))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations, store = spark.read.parquet(f"{sf_dir}/conversations.parquet"), Store(spark)
    turns = damage(conversations)
    return with_hash(turns, store.put(edits(turns, conversations, store), "edits"))
