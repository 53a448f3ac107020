import numpy as np
import pytest
from pyspark.sql import functions as F

from sharpfleet.operators import fits as ft
from sharpfleet.operators import groups as gp
from sharpfleet.operators import ownership as ow
from sharpfleet.operators import stats as sa
from sharpfleet.sources import manifests as mf


def points(spark, n=4000):
    return spark.range(n).select(F.lit(0).alias("stack_id"), F.lit(1).alias("frame"), (F.col("id") * 37 % 640).cast("double").alias("x"),
                                 (F.col("id") * 53 % 480).cast("double").alias("y"), (F.col("id") % 9 / 8.0).alias("depth"), F.lit(1.0).alias("w"))


def test_motion_model_is_recovered(spark):
    p = points(spark)
    truth = [0.004, -0.003, 0.01, 0.02, -0.015, 0.03, 0.02]
    origin = p.agg(F.avg("depth")).first()[0]
    par = p.limit(1).select("stack_id", "frame").withColumn("beta", F.array(*[F.lit(t) for t in truth])).withColumn("origin", F.lit(origin))
    obs = ft.motion_displacement(p, par, ["stack_id", "frame"], 480, 640).withColumnsRenamed({"mdx": "dx", "mdy": "dy"})
    obs = obs.withColumn("dx", F.when(F.col("x") % 40 == 0, F.col("dx") + 30).otherwise(F.col("dx")))
    beta = ft.fit_motion(obs, ["stack_id", "frame"], 480, 640, ridge=1e-9, passes=6).first().beta
    assert np.allclose(beta, truth, atol=2e-3)


def test_shared_scale_and_bins(spark):
    p = points(spark).withColumn("bin", (F.col("x") % 2).cast("int"))
    p = p.withColumns({"dx": 0.01 * (F.col("x") - 319.5) + F.col("bin") * 3, "dy": 0.01 * (F.col("y") - 239.5) - F.col("bin")})
    r = ft.breathing(ft.shared_scale(p, ["stack_id"], 2, 319.5, 239.5), ["stack_id"], 2).first()
    assert np.allclose((r.scale, r.rotation, r.spread_x, r.spread_y), (0.01, 0.0, 3.0, 1.0), atol=1e-6)


def test_depth_curve(spark):
    knots = [0.0, 0.5, 1.0]
    p = points(spark).withColumns({"nx": F.when(F.col("x") % 2 == 0, 0.6).otherwise(0.8), "ny": F.when(F.col("x") % 2 == 0, 0.8).otherwise(-0.6), "score": F.lit(1.0)})
    dx = F.when(F.col("depth") < 0.5, 4 * F.col("depth")).otherwise(2.0)
    p = p.withColumn("shift", dx * F.col("nx") + (1 - F.col("depth")) * F.col("ny"))
    r = ft.fit_curve(p, ["stack_id"], knots).first()
    assert np.allclose(r.cx, [0, 2, 2], atol=1e-6) and np.allclose(r.cy, [1, 0.5, 0], atol=1e-6)


def test_outliers_do_not_move_a_similarity(spark):
    p = points(spark).withColumns({"dx": 0.02 * (F.col("x") - 319.5) + 1, "dy": 0.02 * (F.col("y") - 239.5) - 2})
    p = p.withColumn("dx", F.when(F.col("y") % 10 == 0, 50.0).otherwise(F.col("dx")))
    r = sa.fit_similarity(p, ["stack_id"], 319.5, 239.5, passes=8).first()
    assert abs(r.scale - 0.02) < 2e-3 and abs(r.ty + 2) < 0.1


def test_two_means(spark):
    p = points(spark, 400).withColumns({"dx": F.when(F.col("x") < 320, 0.0).otherwise(6.0), "dy": F.lit(0.0)})
    r = ft.two_means(p, ["stack_id"]).first()
    assert abs(r.separation - 6) < 1e-9
    assert ft.two_means(p.withColumn("dx", F.lit(1.0)), ["stack_id"]).isEmpty()


def test_gate_separates_right_from_wrong(spark):
    p = points(spark, 300).withColumns({"nx": F.when(F.col("x") % 2 == 0, 1.0).otherwise(0.0), "ny": F.when(F.col("x") % 2 == 0, 0.0).otherwise(1.0), "wt": F.lit(0.5)})
    wrong = p.withColumns({"stack_id": F.lit(1), "shift": 8.0 * F.col("nx")})
    blind = p.withColumns({"stack_id": F.lit(2), "nx": F.lit(1.0), "ny": F.lit(0.0), "shift": F.lit(0.2)}).withColumn("ny", F.when(F.col("y") == 0, 0.01).otherwise(0.0))
    both = p.withColumn("shift", F.lit(0.1)).unionByName(wrong).unionByName(blind)
    got = {r.stack_id: r for r in gp.gate(gp.robust_translation(both, ["stack_id"])).collect()}
    assert got[0].status == "verified" and got[1].status == "contradicted" and got[2].reason == "one axis only"


def test_profile_match(spark):
    base = [float(v) for v in (0, 0, 1, 5, 9, 10, 10, 10, 10, 10, 10)]
    moved = base[:2] * 1 + base[:9]
    df = spark.createDataFrame([(base, moved)], "a array<double>, b array<double>")
    r = gp.match(df, "a", "b", 11).first()
    assert abs(r["shift"] - 2) < 0.5 and r.score > 0.9


def test_silent_gate_keeps_every_row(spark):
    base = spark.range(100).select(F.lit(0).alias("stack_id"), F.col("id").cast("int").alias("y"), F.lit(0).alias("x"), F.col("id").alias("v"))
    off = spark.createDataFrame([(0, False)], "stack_id int, fire boolean")
    assert ow.gated(base, base.withColumn("v", -F.col("v")), off, ["v"]).exceptAll(base.select("stack_id", "y", "x", "v")).isEmpty()


def test_pairs_merge_to_the_heaviest(spark):
    t = spark.createDataFrame([(0, 1, 4, 10.0), (0, 2, 5, 3.0), (0, 6, 9, 5.0), (0, 7, 9, 1.0)], "stack_id int, near int, far int, weight double")
    got = {(r.near, r.far): (r.kept_near, r.kept_far) for r in ow.merge_pairs(t).collect()}
    assert got == {(1, 4): (1, 4), (2, 5): (1, 4), (6, 9): (6, 9), (7, 9): (6, 9)}


def test_sinks_and_resume(spark, tmp_path):
    px = spark.range(50).select((F.col("id") % 5).alias("stack_id"), F.col("id").cast("int").alias("y"), F.lit(0).alias("x"), F.lit(7).alias("b"))
    mf.write_pixels(px, str(tmp_path / "px"))
    assert spark.read.parquet(str(tmp_path / "px")).count() == 50
    scenes = spark.createDataFrame([("a",), ("b",), ("c",)], "scene string")
    mf.append_results(scenes.filter("scene <> 'c'"), str(tmp_path / "done"))
    assert [r.scene for r in mf.pending(scenes, spark.read.json(str(tmp_path / "done"))).collect()] == ["c"]
    (tmp_path / "m.json").write_text('{"scenes": [{"scene": "s1", "n": 3},\n {"scene": "s2", "n": 4}]}')
    assert mf.read_manifest(spark, str(tmp_path / "m.json")).agg(F.sum("n")).first()[0] == 7


def test_passes_do_not_move_the_rows(spark):
    """Coefficients and medians of few keys reach the rows without a shuffle of the rows, whatever Spark thinks of their size."""
    from sharpfleet.operators import grid, stats

    rows = spark.range(4000).selectExpr("id % 3 AS stack_id", "cast(id % 37 AS double) AS x", "cast(id % 41 AS double) AS y", "cast(id % 7 + 0.1 * (id % 37) AS double) AS dx", "cast(id % 5 + 0.1 * (id % 41) AS double) AS dy",
                                      "cast(id % 4 AS int) AS bin", "cast(id % 9 AS double) AS depth", "1.0D AS w")
    fits = [lambda: stats.fit_similarity(rows, ["stack_id"], 18.0, 20.0, "w"), lambda: ft.shared_scale(rows, ["stack_id"], 4, 18.0, 20.0), lambda: ft.fit_motion(rows, ["stack_id"], 41, 37)]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    few = grid.FEW
    try:
        for fit in fits[:2]:
            assert "SortMergeJoin" not in fit()._jdf.queryExecution().executedPlan().toString()
        both = []
        for grid.FEW in (few, 0):  # 0: as for more keys than may be broadcast
            both.append([v for f in fits for r in sorted(f().collect()) for c in r for v in (c if isinstance(c, list) else [c])])
        assert both[0] == pytest.approx(both[1], rel=1e-6, abs=1e-9)
    finally:
        grid.FEW = few
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
