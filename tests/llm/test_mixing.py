import random
import re
from collections import Counter

import duckdb

from sharpfleet.llm import mixing as M
from sharpfleet.llm.store import Store

from .common import DATA, empty, given, odd


def sql_rows(table, sql):
    con = duckdb.connect()
    con.register("documents", table)
    return sorted(con.sql(sql).fetchall(), key=str)


def mixed(docs, **more):
    return M.mix(docs, **more).collect()


def by_hand(rows):
    """Sizes and targets in plain Python."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows]
    whole = Counter()
    for r, n in zip(rows, size):
        whole[r["source"]] += n
    names = sorted(whole, key=lambda s: (s is None, s))
    weight, target, free = dict(zip(names, [5, 2, 1] * len(names))), {}, set(names)
    while free:
        rest, w = sum(size) - sum(target.values()), sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * rest / w > 3 * whole[s]]
        for s in over or free:
            target[s] = 3 * whole[s] if over else weight[s] * rest / w
        free -= set(over or free)
    return [(r["doc_id"], n, whole[r["source"]], round(target[r["source"]], 6)) for r, n in zip(rows, size)], target


def sound(rows, out, tolerance):
    want, target = by_hand(rows)
    assert sorted(want, key=str) == sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in out), key=str)
    taken = Counter()
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["times"] * r["size"] + sum(s["words"] for s in r["spans"])
        assert all(0 <= s["first"] and s["words"] > 0 and s["first"] + s["words"] <= r["size"] for s in r["spans"])
        taken[r["source"]] += r["taken"]
    for source, t in target.items():
        assert abs(taken[source] - t) <= tolerance, (source, taken[source], t)  # a shard cuts its words into whole blocks


def test_given_table_equals_sql(spark):
    docs = given(spark)
    out = mixed(docs)
    sound(docs.collect(), out, 2 * M.BLOCK)
    want = sql_rows(duckdb.sql(f"select * from '{DATA}/documents.parquet'").arrow(), M.OP13_SQL)
    assert sorted(((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in out), key=str) == want
    assert sorted(map(str, out)) == sorted(map(str, mixed(docs.repartition(7))))


def test_many_shards_equal_sql(spark):
    r = random.Random(2)
    rows = [(i if i % 9 else None, None if i % 11 == 0 else " ".join("w" * r.randint(1, 9) for _ in range(r.choice([0, 1, 30, 400]))), None if i % 3 == 0 and i % 2 else f"s{min(i % 7, 4)}") for i in range(400)]
    rows += [rows[5]] * 9 + [(1000, "one word each " * 2000, "big")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for block, shard in ((64, 3000), (16, 500)):
        out = mixed(docs, block=block, shard=shard)
        shards = max(-(-x["source_size"] // shard) for x in out)
        sound(docs.collect(), out, 2 * block * (shards + 1))
        want = sql_rows(docs.toArrow(), M.mixing_sql(block, shard))
        got = sorted(((x["doc_id"], x["size"], x["source_size"], x["target"], x["taken"]) for x in out), key=str)
        assert got == want


def test_odd_rows(spark):
    for docs in (odd(spark), odd(spark).unionByName(odd(spark))):
        sound(docs.collect(), mixed(docs, block=4), 16)
    assert mixed(empty(spark)) == []
    assert [x["taken"] for x in mixed(spark.createDataFrame([(1, None, "s"), (2, " ", None)], "doc_id long, text string, source string"))] == [0, 0]


def test_seats_by_hand(spark):
    r = random.Random(1)
    for total in (1, 7, 1000):
        rows = [(g, p, float(r.choice([0, 1, 5, 5, 70, 1000])), total) for g in range(3) for p in range(40)]
        got = M.sainte_lague(spark.createDataFrame(rows, "grp long, party long, votes double, total long"), "grp", Store(spark), "t").collect()
        for g in range(3):
            votes, seats = {p: v for x, p, v, _ in rows if x == g}, Counter()
            for _ in range(total):
                seats[max(votes, key=lambda p: (votes[p] / (2 * seats[p] + 1), -p))] += 1
            assert {x["party"]: x["seats"] for x in got if x["grp"] == g} == {p: seats[p] for p in votes}
