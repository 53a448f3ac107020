"""Edge sites, consensus groups, chains of points and the areas they cover."""

import math
import random

from pyspark.sql import functions as F

from sharpfleet.operators import graph as gr
from sharpfleet.operators import groups as gp
from sharpfleet.operators import ranking as rk
from sharpfleet.operators import sites as si


def image(spark, size, value):
    return spark.sql(f"SELECT 0L AS stack_id, 0 AS frame, CAST(y.id AS INT) AS y, CAST(x.id AS INT) AS x, {size} AS h, {size} AS w, CAST({value} AS INT) AS v FROM range({size}) y, range({size}) x")


def test_components_of_monotone_chains(spark):
    """A long chain whose ids rise along it, a ring and a star: label is the smallest id."""
    edges = [(0, i, i + 1) for i in range(300)] + [(0, 1000 + i, 1000 + (i + 1) % 7) for i in range(7)] + [(1, 5, 6 + i) for i in range(50)]
    nodes = sorted({(k, n) for k, a, b in edges for n in (a, b)} | {(1, 99999)})
    got = gr.connected(spark.createDataFrame(nodes, "k int, node long"), spark.createDataFrame(edges, "k int, a long, b long"), ["k"]).collect()
    want = {(k, n): n if n == 99999 else (5 if k else 0 if n < 1000 else 1000) for k, n in nodes}
    assert {(r["k"], r["node"]): r["label"] for r in got} == want and len(got) == len(want)
    none = gr.connected(spark.createDataFrame([(0, 4)], "k int, node long"), spark.createDataFrame([], "k int, a long, b long"), ["k"]).collect()
    assert [(r["node"], r["label"]) for r in none] == [(4, 4)]


def test_places_in_every_key(spark):
    r = random.Random(1)
    rows = [(r.choice([1, 1, 1, 2, 3]), i) for i in r.sample(range(10_000), 500)]
    got = rk.places(spark.createDataFrame(rows, "stack_id long, feature_id long").repartition(5), ["stack_id"], "feature_id").collect()
    want = {(k, v): i for k in (1, 2, 3) for i, v in enumerate(sorted(v for s, v in rows if s == k))}
    assert {(x["stack_id"], x["feature_id"]): x["place"] for x in got} == want


def test_sites_of_a_step(spark):
    """A fading vertical step gives one column of ridges; its weak end counts, a weak edge of its own does not."""
    px = image(spark, 32, "CASE WHEN x.id >= 16 THEN 120 - 4 * y.id WHEN x.id < 4 THEN 25 ELSE 0 END")
    px = px.withColumn("depth", F.when((F.col("y") >= 10) & (F.col("x") >= 16), 1.0).otherwise(0.0))
    out = si.edge_sites(px, "depth", stride=1, margin=3).collect()
    assert {(r["y"], r["x"]) for r in out if r["y"] < 18} == {(y, 16) for y in range(3, 18)}  # strong above, weak below
    assert all(r["nx"] > 0.95 and r["ny"] < 0 for r in out if r["y"] < 18) and not any(r["x"] < 8 for r in out)
    assert not any(r["limb"] for r in out if r["y"] < 5) and all(r["limb"] for r in out if 14 < r["y"] < 18)
    assert si.edge_sites(image(spark, 16, "7").withColumn("depth", F.lit(0.0)), "depth", stride=1, margin=0).count() == 0


def test_three_planted_motions(spark):
    """Three objects that move apart from each other, one group each, and no feature in two."""
    r, rows, motion = random.Random(3), [], {0: (6.0, 0.0), 1: (0.0, -7.0), 2: (-5.0, 5.0)}
    for i in range(120):
        k = i // 40
        x, y, a = 300.0 * k + r.uniform(0, 90), r.uniform(0, 90), r.uniform(0, 6.28)
        nx, ny = math.cos(a), math.sin(a)
        for frame in range(5):
            t = frame - 2
            rows.append((0, i, frame, x, y, nx, ny, t * (motion[k][0] * nx + motion[k][1] * ny) + r.uniform(-0.2, 0.2)))
    got = gp.consensus_groups(spark.createDataFrame(rows, "stack_id long, feature_id long, frame int, x double, y double, nx double, ny double, shift double")).collect()
    found = {}
    for g in got:
        assert g["feature_id"] not in found
        found[g["feature_id"]] = g["group_id"]
    normal = {r[1]: r[5:7] for r in rows}
    tells = lambda i: all(abs((motion[i // 40][0] - motion[j][0]) * normal[i][0] + (motion[i // 40][1] - motion[j][1]) * normal[i][1]) >= 2.5 for j in range(3) if j != i // 40)
    names = []
    for k in range(3):
        groups = [found.get(i) for i in range(40 * k, 40 * k + 40)]
        names.append(max(set(groups), key=groups.count))
        sure = [i for i in range(40 * k, 40 * k + 40) if tells(i)]  # normals along which no other motion looks the same
        own = [i for i in sure if found.get(i) == names[k]]
        assert len(sure) >= 15 and names[k] is not None and len(own) >= 0.9 * len(sure) and all(found.get(i) in (names[k], None) for i in sure)
    assert len(set(names)) == 3
    few = spark.createDataFrame(rows[:20], "stack_id long, feature_id long, frame int, x double, y double, nx double, ny double, shift double")
    assert gp.consensus_groups(few).count() == 0


def test_areas_of_points(spark):
    """Three chained points cover the stretch between them; a single one covers a disc; nothing else is refused."""
    px = image(spark, 40, "1").withColumn("frame", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    points = spark.createDataFrame([(0, 5.0, 5.0), (0, 15.0, 5.0), (0, 25.0, 5.0), (0, 30.0, 30.0), (0, 30.0, 30.0)], "stack_id long, x double, y double")
    moving = spark.createDataFrame([(0, 0), (0, 1)], "stack_id long, frame int")
    out = {(r["frame"], r["y"], r["x"]) for r in si.refuse_unexplained(px, points, moving, 1, 12.0, 3.0).filter("refused").collect()}
    assert {f for f, _, _ in out} == {0}
    near = lambda y, x: (max(0, 5 - x, x - 25) ** 2 + (y - 5) ** 2 <= 9) or (x - 30) ** 2 + (y - 30) ** 2 <= 9
    assert {(y, x) for _, y, x in out} == {(y, x) for y in range(40) for x in range(40) if near(y, x)}
