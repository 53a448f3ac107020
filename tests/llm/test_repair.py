import hashlib
import itertools
import random
import zlib
from collections import defaultdict

from sharpfleet.llm import repair as R

from .common import given

BLANK = " \t\n\x0b\x0c\r"
NEXT = {("B", "s"): "S", ("B", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}


def parse(rows):
    """Least (cost, audit, roles) row by row over the points of the pattern; rows are (initial, must go, truncated)."""
    def insert(at):
        for _ in range(3):
            for (p, x), q in NEXT.items():
                if p in at and x in "ua":
                    new = (at[p][0] + 5, at[p][1] + "I", at[p][2] + (x,))
                    at[q] = min(at.get(q, new), new)
        return at

    at = insert({"B": (0, "", ())})
    for initial, gone, cut in rows:
        new = {p: (c + 2, a + "D", o) for p, (c, a, o) in at.items()}
        for (p, x), q in NEXT.items():
            if p in at and not gone:
                for cost, letter in ([(0, "K")] if x == initial else []) + ([(1, "R")] if x in "ua" else []):
                    e = (at[p][0] + cost + 5 * cut, at[p][1] + letter, at[p][2] + (x,))
                    new[q] = min(new.get(q, e), e)
        at = insert(new)
    return min(at[p] for p in "BA" if p in at)


def harmed(rows):
    for r in rows:
        conv, turn = (" " if r[c] is None else r[c] for c in ("conv_id", "turn"))
        kind, role, text = zlib.crc32(f"{conv}:{turn}".encode()) % 20, r["role"], r["text"]
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        for _ in range({0: 0, 3: 2}.get(kind, 1)):
            yield r["conv_id"], r["turn"], "user" if kind == 4 else role, text


def by_hand(rows, turns):
    talks = {r["conv_id"]: [] for r in rows}
    for conv, *row in turns:
        talks[conv].append(row)
    for conv, talk in talks.items():
        talk.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, classes, faults = set(), [], defaultdict(int)
        for _, role, text in talk:
            bare = text.strip(BLANK)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "none"
            seen.add((role, text))
            faults[fault] += 1
            classes.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit, roles = parse(classes)
        told, rest, out = iter(talk), iter(roles), []
        for e in audit:
            row = next(told) if e != "I" else None
            if e != "D":
                x = {"s": "system", "u": "user", "a": "assistant"}[next(rest)]
                out.append(f"{row[1] if e == 'K' else x}:{row[2] if row else ''}")
        t = [r[0] for r in talk if r[0] is not None]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(classes, classes[1:]))
        yield (conv, max(t) - min(t) + 1 - len(set(t)) if t else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit,
               hashlib.sha256("\n".join(out).encode()).hexdigest())


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def same(spark, table, partitions=None):
    rows = table.collect()
    if partitions:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = R.damage(table)
        got = R.with_hash(turns, R.edits(turns, table)).select(COLUMNS).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(map(tuple, got), key=str) == sorted(by_hand(rows, harmed(rows)), key=str)


SCHEMA = "conv_id long, turn long, role string, text string, audit string, place string, h long, n long"


def odd(spark):
    r, rows = random.Random(5), []
    for conv in [None, *range(40)]:
        for _ in range(r.choice([1, 2, 3, 9, 30])):
            turn = r.choice([None, *range(-3, 25)])
            role = r.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "User"])
            text = r.choice(["Yes.", "Yes.", "no", "", None, " \t\n", "a\nb!", "é?  ", " ", "long " * 500, f"{conv} {turn}."])
            rows.append((conv, turn, role, text, "x", "y", 1, 2))
    rows += rows[:50]
    return spark.createDataFrame(rows, SCHEMA)


def test_given_table_equals_brute_force(spark):
    same(spark, given(spark, "conversations"))


def test_odd_rows(spark):
    same(spark, odd(spark))
    same(spark, spark.createDataFrame([], SCHEMA))


def test_long_conversations_lie_in_many_partitions(spark):
    r = random.Random(6)
    rows = [(7, t // 2, r.choice(["user", "assistant"]), r.choice(["Well.", f"{t}.", f"{t}!", f"{t}", ""])) for t in range(900)] + [(8, None, "user", "Hi.")] * 40
    same(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 17)


def test_repaired_rows_follow_the_pattern(spark):
    table = odd(spark)
    out = defaultdict(list)
    for x in R.repaired(table, R.edits(table)).orderBy("conv_id", "place").collect():
        out[x["conv_id"]].append(x)
    assert out
    for rows in out.values():
        roles = [x["role"][0] for x in rows]
        body = roles[1:] if roles[0] == "s" else roles
        assert body and body == ["u", "a"] * (len(body) // 2) and [x["place"] for x in rows] == list(range(len(rows)))
        assert all((x["edit"] == "I") == (x["text"] == "") for x in rows)


def test_parser_finds_the_least_edits():
    """Against every sequence of edits of short conversations."""
    by_class = R.rows_of_class()
    legal = lambda o: o == "" or (s := o.removeprefix("s")) and s == "ua" * (len(s) // 2) and "s" not in s

    def every(kinds):
        for ins in itertools.product(["", "u", "a", "ua", "au"], repeat=len(kinds) + 1):
            if len("".join(ins)) > 2:
                continue
            for ops in itertools.product("DKua", repeat=len(kinds)):
                if any(k == "x" and o != "D" or o == "K" and k in "oO" for k, o in zip(kinds, ops)):
                    continue
                roles, audit, cost = ins[0], "I" * len(ins[0]), 5 * len("".join(ins))
                for k, o, more in zip(kinds, ops, ins[1:]):
                    roles += ("" if o == "D" else k.lower() if o == "K" else o) + more
                    audit += ("R" if o in "ua" else o) + "I" * len(more)
                    cost += (2 if o == "D" else (5 if k.isupper() else 0) + (o in "ua"))
                if legal(roles):
                    yield cost, audit

    r = random.Random(3)
    for kinds in [*itertools.product("suaoSUAOx", repeat=2), *("".join(r.choices("suaoSUAOx", k=n)) for n in (1, 3, 3, 4, 4) for _ in range(12))]:
        assert R.best(R.joined([by_class[k] for k in kinds])) == min(every(kinds))
