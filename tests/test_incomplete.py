"""Many features on few pixels, images that end early, frames that are missing."""

import collections
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from sharpfleet.operators import focus as fo
from sharpfleet.operators import registration as rg
from sharpfleet.operators import stencil as st
from sharpfleet.operators import surfaces as sf


def test_patches_of_features_are_never_broadcast(spark, formula):
    e = formula(size=8).withColumn("e", F.col("v").cast("double"))
    features = spark.range(400).select(F.lit(0).alias("stack_id"), F.col("id").alias("feature_id"), (F.col("id") % 8).cast("double").alias("x"),
                                       (F.floor(F.col("id") / 8) % 8).cast("double").alias("y"))
    got = fo.feature_focal_frame(e, features, 2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    patch = plan[plan.index("SortMergeJoin"):]
    assert "Generate" in patch and "Generate" not in plan[:plan.index("SortMergeJoin")]
    rows = {r["feature_id"]: (r["focal"], r["energy"]) for r in got.collect()}
    assert len(rows) == 400
    px = [r for r in e.collect()]
    for fid in (0, 27, 63, 64 + 27):
        y, x = fid // 8 % 8, fid % 8
        mean = {}
        for f in range(5):
            v = [r["e"] for r in px if r["frame"] == f and abs(r["y"] - y) <= 2 and abs(r["x"] - x) <= 2]
            mean[f] = round(sum(v) / len(v), 9)
        best = max(mean, key=lambda f: (mean[f], -f))
        assert rows[fid] == (best, mean[best])


def cut_short(formula, **kw):
    """A 16×16 image that ends within its fifth row of tiles."""
    return formula(size=16, frames=1, **kw).filter("y < 8 OR y < 12 AND x < 5")


def direct(image, y, x, taps):
    fold = lambda p: -p if p < 0 else 30 - p if p > 15 else p
    return sum(t * image.get((fold(y + dy), fold(x + dx)), 0) for (dy, dx), t in taps.items())


def test_kernels_take_missing_pixels_as_zero(formula):
    px = cut_short(formula)
    image = {(r["y"], r["x"]): r["v"] for r in px.collect()}
    gx = {(dy, dx): dx * (2 if dy == 0 else 1) for dy in (-1, 0, 1) for dx in (-1, 1)}
    lap = {(-1, -1): 2, (-1, 1): 2, (0, 0): -8, (1, -1): 2, (1, 1): 2}
    rows = st.derivatives(px, "v", ("gx", "lap3"), side=8).collect()
    assert len(rows) == len(image)
    for r in rows:
        assert (r["gx"], r["lap3"]) == (direct(image, r["y"], r["x"], gx), direct(image, r["y"], r["x"], lap))
    wide = {(dy, dx): 1.0 + dy + 5 * dx for dy in range(-2, 3) for dx in range(-2, 3)}
    for r in st.conv2d(px, "v", wide, "c", side=8).collect():
        assert r["c"] == direct(image, r["y"], r["x"], wide)
    line = [1.0, 2.0, 3.0, 4.0, 3.0, 2.0, 7.0]
    for r in st.conv1d(px, {"c": "v"}, line, "y", side=8).collect():
        assert r["c"] == direct(image, r["y"], r["x"], {(k - 3, 0): t for k, t in enumerate(line)})


def test_a_calm_field_that_ends_early_stays(formula):
    px = cut_short(formula).withColumns({"dispx": F.col("x") * 0.05, "dispy": F.col("y") * 0.05})
    for r in rg.limit_stretch(px, rounds=2, sigma=0.6).collect():
        assert abs(r["dispx"] - r["x"] * 0.05) < 1e-12 and abs(r["dispy"] - r["y"] * 0.05) < 1e-12


def test_agreement_pools_squares_around_missing_pixels(formula):
    px = cut_short(formula).withColumns({"a": F.col("v"), "b": F.when(F.expr("y = 8 AND x = 4"), 255 - F.col("v")).otherwise(F.col("v"))}).drop("frame")
    rows = {(r["y"], r["x"]): r for r in sf.agreement(px, "a", "b", F.lit(0), F.lit(0), 1, 0.01, 3).collect()}
    wrong = {p for p, r in rows.items() if not r["agree"]}
    assert len(rows) == 148 and (8, 4) in wrong
    assert all(r["unanimous"] == (not any(abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1 for q in wrong)) for p, r in rows.items())


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Five stacks of 125 arrays, four of which end early: within a row of tiles, within a frame, after two frames, after one array."""
    folder = tmp_path_factory.mktemp("odd")
    one = "concat('[', array_join(transform(sequence(1, 64), i -> cast((pmod(hash(id, i), 200) - 100) / 256.0 as float)), ','), ']')"
    ends = F.element_at(F.array(*[F.lit(n) for n in (125, 81, 63, 50, 1)]), (F.floor(F.col("id") / 125) + 1).cast("int"))
    rows = spark.range(625).filter(F.col("id") % 125 < ends).select(F.col("id").alias("vec_id"), F.from_json(F.expr(one), "array<float>").alias("embedding"))
    rows.coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("key", ["J9_fallback_chain", "J10_profiles", "J11_profile_match", "J12_shift_search", "F1_laplacian", "F5_content_aware", "G14_footprint_crop",
                                 "T1_tile_pairs", "T4_layer_masks"])
def test_stacks_that_end_early_equal_their_sql(spark, odd, key):
    import __spark_entry__ as entry
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{Path(odd)}/embeddings.parquet/*.parquet'")
    got = entry.queries()[key](spark, str(odd))
    rel = con.execute(entry.oracle_sql()[key])
    names = [d[0] for d in rel.description]
    want = collections.Counter(tuple(map(repr, r)) for r in rel.fetchall())
    assert want and collections.Counter(tuple(map(repr, r)) for r in got.select(*names).collect()) == want


def test_limits_are_decided_the_same_in_any_order_of_sums(spark):
    from sharpfleet.operators import groups as gp
    motion = spark.createDataFrame([(0, 1, 1.9999999999999996, 0.0)], "stack_id int, frame int, mx double, my double")
    res = spark.createDataFrame([(0, 1, 1.0, 0.0, 1.9999999999999996, 3), (0, 2, 1.0, 0.0, 1.5, 3), (0, 3, 0.6, 0.8, 0.1, 3)],
                                "stack_id int, feature_id int, nx double, ny double, rms double, frames int")
    assert [r["feature_id"] for r in gp.consensus(res, motion).collect()] == [2]  # 1 is on the limit, 3 can't see the motion


@pytest.fixture(scope="module")
def short(spark, tmp_path_factory):
    """Arrays 0–33, 40–41 and 125–130: stacks of four tiles end within a frame or after one, those of 25 tiles within a row of tiles."""
    folder = tmp_path_factory.mktemp("short")
    one = "concat('[', array_join(transform(sequence(1, 64), i -> cast((pmod(hash(id, i), 200) - 100) / 256.0 as float)), ','), ']')"
    rows = spark.range(131).filter("id < 34 OR id IN (40, 41) OR id > 124").select(F.col("id").alias("vec_id"), F.from_json(F.expr(one), "array<float>").alias("embedding"))
    rows.coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return folder


def assert_equals_its_sql(spark, folder, key):
    import __spark_entry__ as entry
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{Path(folder)}/embeddings.parquet/*.parquet'")
    got = entry.queries()[key](spark, str(folder))
    rel = con.execute(entry.oracle_sql()[key])
    names = [d[0] for d in rel.description]
    want = collections.Counter(tuple(map(repr, r)) for r in rel.fetchall())
    assert want and collections.Counter(tuple(map(repr, r)) for r in got.select(*names).collect()) == want


def test_expansion_takes_missing_pixels_as_zero(spark, short):
    assert_equals_its_sql(spark, short, "Y3_pyr_up")


def test_detail_bands_take_missing_pixels_as_zero(spark, short):
    assert_equals_its_sql(spark, short, "Y4_laplacian_pyramid")


def test_collapse_gives_back_images_that_end_early(spark, short):
    assert_equals_its_sql(spark, short, "Y5_collapse")


def test_collapse_has_the_pixels_of_the_finest_band(formula):
    """Some pixels have no coarser one above them, some coarser ones lack pixels below."""
    from sharpfleet.operators import pyramid as py
    px = formula(size=16, frames=1).filter("y < 9 AND x <> 8 AND NOT (x > 9 AND x % 2 = 0) OR y = 11 AND x > 8")
    got = py.collapse(py.pyramid(px, ["v"], depth=3, side=8), ["v"], ("frame",), side=8, depth=3)
    assert {(r["y"], r["x"]): r["v"] for r in got.collect()} == {(r["y"], r["x"]): r["v"] for r in px.collect()}


def test_median_of_the_pixels_there_are(spark, short, formula):
    assert_equals_its_sql(spark, short, "K15_median_filter")
    px = formula(size=8, frames=1).filter("y < 4 OR x < 3").withColumn("depth", F.col("v") / 7)
    image = {(r["y"], r["x"]): r["depth"] for r in px.collect()}
    keep = lambda p: max(0, min(7, p))
    for r in st.median_filter(px, "depth", 5, side=8).collect():
        near = sorted(image[c] for c in ((keep(r["y"] + dy), keep(r["x"] + dx)) for dy in range(-2, 3) for dx in range(-2, 3)) if c in image)
        assert r["median"] == (near[(len(near) - 1) // 2] + near[len(near) // 2]) / 2


def test_sharpest_frame_does_not_depend_on_the_order_of_sums(spark):
    e = spark.createDataFrame([(0, 0, 0, 0, 0.6), (0, 0, 0, 1, 0.0), (0, 0, 0, 2, 0.0), (0, 1, 0, 0, 0.1), (0, 1, 0, 1, 0.2), (0, 1, 0, 2, 0.3)],
                              "stack_id int, frame int, y int, x int, e double").repartition(1).sortWithinPartitions("x")
    members = e.filter("frame = 0").select("stack_id", "y", "x", F.lit(7).alias("cell"))
    assert [(r["frame"], r["total"]) for r in fo.sharpest_frame(e, members, "cell").collect()] == [(0, 0.6)]


def test_enlarging_takes_missing_pixels_as_zero(spark, short):
    assert_equals_its_sql(spark, short, "Y12_native_field")


def test_frames_without_a_next_one_have_no_composite(spark, short):
    assert_equals_its_sql(spark, short, "V35_finalize")


def test_instability_is_a_share_for_any_number_of_frames(spark, short):
    from sharpfleet.operators import fusion as fu
    assert_equals_its_sql(spark, short, "M12_instability")
    px = spark.range(128).selectExpr("0 AS stack_id", "cast(id div 64 AS int) AS frame", "cast(id % 64 div 8 AS int) AS y", "cast(id % 8 AS int) AS x", "8 AS h", "8 AS w", "cast(id * id % 251 AS int) AS gray")
    assert not any(r["coherent"] for r in fu.consistency_route(px, threshold=0.0).collect())  # two frames never share a decision


@pytest.mark.parametrize("key", ["M2_pyramid_fusion", "M7_multiband_blend", "M15_adaptive_fusion", "M10_perband_fusion", "M10_usable_perband", "M11_boundary_perband"])
def test_fused_images_that_end_early_equal_their_sql(spark, short, key):
    assert_equals_its_sql(spark, short, key)


def test_limiting_the_field_has_an_effect(spark, short, monkeypatch):
    import __spark_entry__ as entry
    assert_equals_its_sql(spark, short, "G10_limit_stretch")
    run = lambda: {tuple(r) for r in entry.queries()["G10_limit_stretch"](spark, str(short)).collect()}
    limited = run()
    monkeypatch.setattr(rg, "limit_stretch", lambda field, **kw: field)
    assert len(run() - limited) > len(limited) / 2


def test_lags_are_matched_a_batch_at_a_time(spark):
    from sharpfleet.operators import groups as gp
    n, cell = 7, lambda i, j, s: None if (i * 31 + j * 7 + s) % 11 == 0 else float((i * 37 + j * j * 13 + s * 29 + i * j * 5) % 101)
    rows = [(i, [cell(i, j, 1) for j in range(n)], [cell(i, j, 2) for j in range(n)]) for i in range(60)] + [(60, [None] * n, [1.0] * n)]
    m = gp.match(spark.createDataFrame(rows, "id int, a array<double>, b array<double>"), "a", "b", n)
    assert "zip_with" not in m._jdf.queryExecution().executedPlan().toString()  # interpreted for each pair: half of the whole time
    got = {r["id"]: (r["shift"], r["score"]) for r in m.collect()}
    minus = lambda p, q: None if p is None or q is None else p - q
    half = lambda p, i: minus(p[min(i + 1, n - 1)], p[max(i - 1, 0)])
    slopes = lambda p: [None if (e := half(p, i)) is None else e / (1 if i in (0, n - 1) else 2) for i in range(n)]
    dot = lambda pairs: (lambda e: sum(e) if e else None)([u * w for u, w in pairs if u is not None and w is not None])
    for i, a, b in rows:
        ga, gb, corr = slopes(a), slopes(b), {}
        aa, bb = dot(list(zip(ga, ga))), dot(list(zip(gb, gb)))
        for k in range(1 - n, n):
            ends = [(j, j + k) for j in range(n) if 0 <= j + k < n]
            if any(a[p] is not None and b[q] is not None for p, q in ends) and aa is not None and bb is not None:
                c = dot([(ga[p], gb[q]) for p, q in ends])
                if c is not None:
                    corr[k] = round(c / ((aa * bb) ** 0.5 + 1e-12), 9)
        if not corr:
            assert got[i] == (None, None)
            continue
        k = max(corr, key=lambda k: (corr[k], -k))
        off = 0.0
        if abs(k) < n - 1 and k - 1 in corr and k + 1 in corr and abs(curve := corr[k - 1] - 2 * corr[k] + corr[k + 1]) > 1e-9:
            off = max(-0.5, min(0.5, 0.5 * (corr[k - 1] - corr[k + 1]) / curve))
        assert got[i][1] == corr[k] and abs(got[i][0] - k - off) < 1e-6
