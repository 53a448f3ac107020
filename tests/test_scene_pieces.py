import math
import random

import numpy as np
from pyspark.sql import functions as F

from sharpfleet.operators import pieces as pc
from sharpfleet.operators import scene as sc

H, W = 480, 640


def test_two_objects_are_told_apart(spark):
    """Shifts made from known motions and depths; a third of the features start with the wrong object."""
    r, rows, labels, truth = random.Random(4), [], [], {}
    motion = {k: (0.002 * k, 1.5 * k, -0.8 * k, 0.004 * k) for k in range(1, 5)}
    for i in range(60):
        x, y, a, o = r.uniform(0, W), r.uniform(0, H), r.uniform(0, math.pi), i % 2
        nx, ny, ux, uy, rho = math.cos(a), math.sin(a), x - (W - 1) / 2, y - (H - 1) / 2, (1.0, -1.0)[o]
        truth[i] = o
        labels.append((1, i, 1 - o if i % 3 == 0 else o))
        for k, (w, tx, ty, tz) in motion.items():
            rows.append((1, i, k, x, y, nx, ny, w * (ux * ny - uy * nx) + rho * (tz * (ux * nx + uy * ny) - tx * nx - ty * ny), 1.0))
    obs = spark.createDataFrame(rows, "stack_id long, feature_id long, frame int, x double, y double, nx double, ny double, shift double, score double")
    start = spark.createDataFrame(labels, "stack_id long, feature_id long, object_id long")
    found = sc.alternate(obs, start, spark.createDataFrame([(1, 0, 1.0), (1, 1, 0.2)], "stack_id long, object_id long, rho double"), H, W)
    got = {x["feature_id"]: x["object_id"] for x in found.labels.collect()}
    same = sum(got[i] == truth[i] for i in got)
    assert len(got) == 60 and max(same, 60 - same) == 60
    audit = sorted(found.audit.collect(), key=lambda a: a["round"])
    assert audit[-1]["rms"] < 1e-3 < audit[0]["rms"] and audit[-1]["moved"] == 0 and len(audit) <= sc.ROUNDS
    assert sorted(round(x["rho"], 6) for x in found.depths.collect()) == [-1.0, 1.0]


def test_pieces_cover_every_pixel(spark):
    """Two levels with a jump between them and a ramp: two pieces, each pixel in one; a frame without room for a piece has none."""
    depth = lambda s, y, x: 0.9 if s == 1 and x >= 10 else 0.01 * y if s == 1 else float((x + y) // 2 % 2)
    rows = [(s, 0, y, x, 24, 24, depth(s, y, x)) for s in (1, 2) for y in range(24) for x in range(24)]
    px = spark.createDataFrame(rows, "stack_id long, frame int, y int, x int, h int, w int, depth double")
    got = pc.cut_pieces(px, "depth", 0.25, 1, 40, side=8)
    piece = {(r["stack_id"], r["y"], r["x"]): r["piece"] for r in got.collect()}
    assert len(piece) == len(rows)
    assert all(piece[1, y, x] == (x >= 10) for y in range(24) for x in range(24))
    assert {v for (s, _, _), v in piece.items() if s == 2} == {None}
    assert [(r["piece"], r["area"]) for r in pc.piece_table(got.filter("stack_id = 1")).orderBy("piece").collect()] == [(0, 240), (1, 336)]


def test_far_pixels_find_their_label(spark):
    seeds = {(0, 0): 7, (29, 20): 3}
    rows = [(1, 0, y, x, 30, 30, seeds.get((y, x))) for y in range(30) for x in range(30)]
    px = spark.createDataFrame(rows, "stack_id long, frame int, y int, x int, h int, w int, piece int")
    got = {(r["y"], r["x"]): r["piece"] for r in pc.nearest_label(px, "piece", 2, side=16).collect()}
    want = {(y, x): min(((y - a) ** 2 + (x - b) ** 2, a, b, v) for (a, b), v in seeds.items())[3] for y in range(30) for x in range(30)}
    assert got == want


def test_motion_reaches_the_rows_without_a_shuffle(spark):
    """Motions of few frames are broadcast to the observations, whatever Spark thinks of their size."""
    from pyspark.sql import functions as F
    from sharpfleet.operators import scene
    from sharpfleet.runtime import cut

    obs = spark.range(200).selectExpr("0 AS stack_id", "id div 4 AS feature_id", "cast(id % 4 AS int) AS frame", "1D AS x", "2D AS y", "1D AS nx", "0D AS ny", "0.5D AS shift", "1D AS score")
    motion = cut(obs.groupBy("stack_id", "frame").agg(*[F.avg("shift").alias(c) for c in ("omega", "tx", "ty", "tz")]))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sums = scene.feature_sums(obs, motion, 4, 4)
        assert "SortMergeJoin" not in sums._jdf.queryExecution().executedPlan().toString() and sums.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
