"""S rows and the whole run: sources, inventories, resume, method dispatch."""

from pyspark.sql import functions as F

from checks.q_a_kernels import ID, ids, px
from checks.q_b_focus import PX, energy_sql, pxs, winner_sql
from checks.q_d_fusion import GRAY, exposed
from checks.registry import Q, add
from sharpfleet.operators import evidence as ev
from sharpfleet.plans import fuse
from sharpfleet.sources import derived as d
from sharpfleet.sources import images as im
from sharpfleet.sources import manifests as mf

paths = lambda s, f: d.table(s, f, "documents").select(F.concat(F.lit("/data/"), "source", F.lit("/"), F.lpad(F.floor(F.col("doc_id") / 4).cast("string"), 3, "0"), F.lit("_"), F.substring(F.lit("ABFX"), (F.col("doc_id") % 4 + 1).cast("int"), F.lit(1)), F.lit("."), F.element_at(F.array(*[F.lit(e) for e in ("png", "JPG", "txt", "tiff", "webp")]), (F.col("n_chars") % 5 + 1).cast("int"))).alias("path"), "n_chars")
PATHS = """SELECT '/data/' || source || '/' || lpad(CAST(doc_id // 4 AS VARCHAR), 3, '0') || '_' || substr('ABFX', CAST(doc_id % 4 + 1 AS INT), 1) || '.' || ['png','JPG','txt','tiff','webp'][CAST(n_chars % 5 + 1 AS INT)] AS path, n_chars FROM documents"""
add("S1_expand_paths", lambda s, f: im.keep_images(paths(s, f)).select("path"), f"SELECT DISTINCT path FROM ({PATHS}) WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('jpg','jpeg','png','tif','tiff','bmp','webp')")
add("S2_frame_numbers", lambda s, f: im.number_frames(im.with_folder(im.keep_images(paths(s, f)))).select("path", "folder", "name", "frame"),
    f"SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(path, '([^/]*)$', 1) AS name, CAST(row_number() OVER (PARTITION BY regexp_extract(path, '^(.*)/[^/]*$', 1) ORDER BY path) - 1 AS INT) AS frame FROM (SELECT DISTINCT path FROM ({PATHS}) WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('jpg','jpeg','png','tif','tiff','bmp','webp'))")


def decoded(s, f):
    """Colour frames packed to BGR bytes the way the image source delivers them, then read back."""
    p = d.colour(px(s, f))
    two = lambda c: F.lpad(F.hex(F.col(c)), 2, "0")
    packed = p.groupBy("stack_id", "frame", "h", "w").agg(F.sort_array(F.collect_list(F.struct("y", "x", F.concat(two("b"), two("g"), two("r")).alias("t")))).alias("_a"))  # 64 pixels per frame
    data = F.unhex(F.array_join(F.transform("_a", lambda e: e["t"]), ""))
    return im.frame_pixels(packed.select("stack_id", "frame", "h", "w", F.lit(3).alias("n_channels"), data.alias("data"))).select(*ID, "b", "g", "r")


add("S3_decode_pixels", decoded, Q().pixels().colour().select(f"SELECT {ids}, b, g, r FROM px3"))
add("S4_array_pixels", lambda s, f: px(s, f, 5).select(*ID, "v"), Q().pixels(5).select(f"SELECT {ids}, v FROM px"))
reg = lambda s, f: im.with_folder(paths(s, f)).select("folder", F.col("path").alias("origin"), (F.col("n_chars") % 100).cast("int").alias("h"), F.lit(640).alias("w"), F.lit(3).alias("n_channels"))
add("S5_registry", lambda s, f: im.registry(reg(s, f).groupBy("folder", "origin", "w", "n_channels").agg(F.max("h").alias("h")), "folder").select("folder", "files", "first", F.col("sample_shape.h").alias("h")),
    f"WITH p AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, path, max(CAST(n_chars % 100 AS INT)) AS h FROM ({PATHS}) GROUP BY ALL) SELECT folder, count(*) AS files, min(path) AS first, arg_min(h, path) AS h FROM p GROUP BY 1")
add("S6_inventory", lambda s, f: im.inventory(im.with_folder(paths(s, f))), f"SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, count(*) AS frames FROM ({PATHS}) GROUP BY 1")


def manifest(s, f):
    o = d.table(s, f, "orders")
    js = o.groupBy(F.col("o_custkey").alias("k")).agg(F.to_json(F.struct(F.collect_list(F.struct(
        F.col("o_orderkey").cast("string").alias("scene"), F.col("o_orderstatus").alias("stratum"), (F.col("o_orderkey") % 500).alias("core_pixels"), (F.col("o_orderkey") % 70).alias("inner_veil_pixels"),
        (F.col("o_orderkey") % 30).alias("outer_veil_pixels"), ((F.col("o_orderkey") % 8) / 8.0).alias("core_fraction"))).alias("scenes"))).alias("js"))  # one customer's orders per manifest
    return mf.parse_manifests(js, "js")


add("S7_manifest", manifest, "SELECT CAST(o_orderkey AS VARCHAR) AS scene, o_orderstatus AS stratum, o_orderkey % 500 AS core_pixels, o_orderkey % 70 AS inner_veil_pixels, o_orderkey % 30 AS outer_veil_pixels, (o_orderkey % 8)/8.0::DOUBLE AS core_fraction FROM orders")
add("S8_triples", lambda s, f: im.triples(paths(s, f)), f"""WITH p AS (SELECT substr(regexp_extract(path, '([^/]*)$', 1), 1, 3) AS id, regexp_extract(path, '_([A-Z])\\.', 1) AS role, path FROM ({PATHS})),
 t AS (SELECT id, min(path) FILTER (role = 'A') AS "A", min(path) FILTER (role = 'B') AS "B", min(path) FILTER (role = 'F') AS "F" FROM p GROUP BY id) SELECT * FROM t WHERE "A" IS NOT NULL AND "B" IS NOT NULL AND "F" IS NOT NULL""")
add("S11_pending", lambda s, f: mf.pending(d.table(s, f, "orders").select(F.col("o_orderkey").alias("scene")), d.table(s, f, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("scene"))),
    "SELECT o_orderkey AS scene FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")


def complete(s, f):
    li = d.table(s, f, "lineitem").select(F.col("l_orderkey").alias("stack_id"), F.col("l_linenumber").alias("frame"), F.col("l_partkey").alias("mask_id"))
    n = d.table(s, f, "orders").select(F.col("o_orderkey").alias("stack_id"), (F.col("o_custkey") % 4 + 1).alias("n"))
    return im.complete_stacks(li, n)


add("S12_complete_stacks", complete, "SELECT l_orderkey AS stack_id, l_linenumber AS frame, l_partkey AS mask_id FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, o_custkey HAVING count(DISTINCT l_linenumber) = o_custkey % 4 + 1)")
add("M16_run_max", lambda s, f: fuse.run(d.colour(px(s, f)), "max"),
    winner_sql(energy_sql(exposed(Q().pixels().colour()).add("gp", f"SELECT {ids}, h, w, b, g, r, {GRAY} FROM nx"), "laplacian", 9, "gp")).select(f"SELECT {pxs}, b, g, r FROM wn JOIN gp USING ({pxs}) WHERE frame = winner"))
