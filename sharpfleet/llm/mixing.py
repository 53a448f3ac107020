"""Mixing of sources to target weights by Sainte-Laguë apportionment.

Words are dealt in blocks of equal length. The blocks of the whole mix go to the sources by the highest quotients
target / (2 s - 1), those of a source to its shards by the highest quotients words / (2 s - 1); a shard then takes all its
blocks as often as its quota allows and a seeded choice of them once more. Shards are bounded, so a source that holds
most rows is spread over many; tables of sources and shards stay distributed, the driver sees totals only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sharpfleet.llm.store import Store
from sharpfleet.operators.grid import attach

WEIGHTS, CAP = (5, 2, 1), 3
BLOCK = 64  # words of a block
SHARD = 1 << 20  # words of a shard, on average


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def key_of(source: str) -> Column:
    """A key without nulls."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def seeded(*parts) -> Column:
    """Hexadecimal hash that orders rows or blocks at random; the same in every run."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def numbered(rows: DataFrame, order: list[Column], store: Store, name: str) -> DataFrame:
    """``rows`` with their ``place`` in the given order, from 0. Only a count per partition reaches the driver."""
    d = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    d, part = store.put(d, name), F.shiftright("_id", 33)
    before, total = [], 0
    for r in d.groupBy(part.alias("part")).count().orderBy("part").collect():
        before += [F.lit(r["part"]), F.lit(total).cast("long")]
        total += r["count"]
    start = F.element_at(F.create_map(*before), part) if before else F.lit(0)
    return d.withColumn("place", (start + F.col("_id").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_id")


def sainte_lague(parties: DataFrame, by: str, store: Store, name: str) -> DataFrame:
    """``seats`` of every party: the ``total`` seats of its group ``by`` go to the highest ``votes`` / (2 s - 1), ties to the smaller ``party``.

    With n parties and q = votes · total / all votes, seats below q (1 - n / 2 total) - 1/2 are certain and seats above
    q (1 + n / 2 total) + 1/2 are out, so only about 2 n quotients need an order, however many seats there are. Each
    group's ``total`` stands in all its rows; parties without votes get no seat.
    """
    sums = parties.groupBy(by).agg(F.sum("votes").alias("_all"), F.count("*").alias("_n"))
    d = attach(parties, sums, [by])
    q, slack = F.col("votes") * F.col("total") / F.col("_all"), F.col("_n") / (2 * F.col("total"))
    none = (F.col("votes") <= 0) | (F.col("total") <= 0)
    sure = F.when(none, 0).otherwise(F.greatest(F.lit(0), F.ceil(q * (1 - slack) + 0.5) - 2)).cast("long")
    open_ = F.when(none, 0).otherwise(F.floor(q * (1 + slack) + 0.5) + 1).cast("long")
    d = store.put(d.withColumns({"sure": sure, "open": open_}).drop("_all", "_n"), f"{name}-parties")
    rows = d.filter("open > sure").select(by, "party", F.explode(F.sequence(F.col("sure") + 1, F.col("open"))).alias("seat"), "votes")
    rows = rows.select(by, "party", (F.col("votes") / (2 * F.col("seat") - 1)).alias("quotient"))
    placed = numbered(rows, [F.col(by), F.desc("quotient"), F.col("party")], store, f"{name}-quotients")
    left = d.groupBy(by).agg((F.first("total") - F.sum("sure")).alias("_left"))
    left = left.join(placed.groupBy(by).agg(F.min("place").alias("_first")), by)
    won = attach(placed, left, [by]).filter(F.col("place") - F.col("_first") < F.col("_left")).groupBy(by, "party").agg(F.count("*").alias("_won"))
    return d.join(won, [by, "party"], "left").withColumn("seats", F.col("sure") + F.coalesce("_won", F.lit(0))).drop("sure", "open", "_won")


def targets(sources: DataFrame, weights: tuple, cap: int) -> tuple[DataFrame, int]:
    """``target`` of every source (``place``, ``source_size``) and the sum of all sizes.

    Sources weigh ``weights`` in turn. A target stops at ``cap`` times its source's size; what is cut off is shared again
    by weight among the others until no target is above. A round is one aggregate.
    """
    d = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long"))
    whole, limit = d.agg(F.sum("source_size")).first()[0] or 0, cap * F.col("source_size")
    rest, weight, capped = whole, d.agg(F.sum("weight")).first()[0] or 1, 0
    while True:
        share = F.col("weight") * F.lit(rest) / F.lit(weight)
        r = d.agg(F.sum((share > limit).cast("long")).alias("n"), F.sum(F.when(share > limit, limit).otherwise(0)).alias("gone"), F.sum(F.when(share > limit, 0).otherwise(F.col("weight"))).alias("w")).first()
        if (r["n"] or 0) == capped or not r["w"]:
            return d.withColumn("target", F.when(share > limit, limit.cast("double")).otherwise(share)), whole
        rest, weight, capped = whole - r["gone"], r["w"], r["n"]


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, block: int = BLOCK, shard: int = SHARD, seed: str = "mix") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size in words, source_size, target, ``times`` the whole text is taken,
    ``spans`` (first word, words) that are taken once more, and ``taken``, the words the mix takes, repeats counted.

    Sources come in code-point order, null last as a source of its own. Null and empty texts have size 0 and are not
    taken. Rows of one doc_id, source and size are told apart by their order only; rows without id are dealt with
    like others. An empty table gives an empty one. Other columns are not read.
    """
    store = Store(docs.sparkSession)
    units = docs.select("doc_id", "source", size_of("text").alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    units = store.put(units, "units")
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sources, whole = targets(numbered(sources, [F.col("source").asc_nulls_last()], store, "ordered"), weights, cap)
    parties = sources.select(key_of("source").alias("key"), "source_size", "target", F.col("place").alias("party"), F.lit(0).alias("all"), F.col("target").alias("votes"), F.lit((2 * whole + block) // (2 * block)).alias("total"))
    sources = store.put(sainte_lague(parties, "all", store, "sources"), "sources")

    own = sources.select("key", F.col("party").alias("src"), "source_size", "target", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard)).cast("long").alias("_shards"))
    h = seeded(F.lit(seed), F.col("doc_id"), F.col("size"))
    dealt = attach(units.withColumns({"key": key_of("source"), "h": h}), own, ["key"])
    dealt = dealt.withColumn("shard", F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), F.col("_shards"))).drop("key", "_shards")

    s = dealt.groupBy("src", "shard").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    s = attach(s, sources.select(F.col("party").alias("src"), F.col("seats").alias("total")), ["src"])
    s = sainte_lague(s.select("src", F.col("shard").alias("party"), "words", F.col("words").cast("double").alias("votes"), "total"), "src", store, "shards")
    s = s.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("src", "party"))  # few bytes a shard, but its blocks are drawn there; by the plain keys Spark leaves the exchange out
    s = s.withColumn("blocks", F.greatest(F.lit(1), F.floor(F.col("words") / block + 0.5)).cast("long"))
    s = s.withColumn("seats", F.least("seats", cap * F.col("blocks")))
    place = lambda j: seeded(F.lit(seed), F.col("src"), F.col("party"), j)
    more = (F.col("seats") % F.col("blocks")).cast("int")
    drawn = F.element_at(F.array_sort(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), place)), F.greatest(more, F.lit(1)))
    s = s.select("src", F.col("party").alias("shard"), "words", "blocks", F.floor(F.col("seats") / F.col("blocks")).alias("times"), F.when(more > 0, drawn).otherwise("").alias("drawn"))
    s = store.put(s, "shards")

    run = Window.partitionBy("src", "shard").orderBy("h", F.col("doc_id").asc_nulls_first(), "size")
    d = dealt.withColumn("at", F.sum(F.col("size") * F.col("n")).over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") * F.col("n"))
    d = d.join(s, ["src", "shard"])
    many = 4096  # rows that repeat are told apart in two steps, so that no array grows with them
    d = d.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(many).cast("long"))))
    d = d.withColumn("_i", F.explode(F.sequence(F.col("_i"), F.least(F.col("_i") + many, F.col("n")) - 1)))
    d = d.withColumn("at", F.col("at") + F.col("_i") * F.col("size"))
    block_at = lambda x: F.expr(f"(({x}) * blocks - 1) div words")  # noqa: E731 the block that holds word x - 1
    edge = lambda j: F.call_function("div", j * F.col("words"), F.col("blocks"))
    seen = F.sequence(block_at("at + 1"), block_at("at + size"))
    hit = F.filter(seen, lambda j: seeded(F.lit(seed), F.col("src"), F.col("shard"), j) <= F.col("drawn"))
    first, last = (lambda j: F.greatest(F.col("at"), edge(j))), (lambda j: F.least(F.col("at") + F.col("size"), edge(j + 1)))
    spans = F.transform(hit, lambda j: F.struct((first(j) - F.col("at")).alias("first"), (last(j) - first(j)).alias("words")))
    d = d.withColumn("spans", F.when((F.col("size") > 0) & (F.col("drawn") > ""), spans).otherwise(F.array().cast("array<struct<first:bigint,words:bigint>>")))
    d = d.withColumn("times", F.when(F.col("size") > 0, F.col("times")).otherwise(0))
    taken = F.col("times") * F.col("size") + F.aggregate("spans", F.lit(0).cast("long"), lambda t, x: t + x["words"])
    return d.select("doc_id", "source", "size", "source_size", "target", "times", "spans", taken.alias("taken"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def mixing_sql(block: int = BLOCK, shard: int = SHARD) -> str:
    """The same mix by whole sets of quotients and blocks."""
    return rf"""
WITH RECURSIVE u AS (
  SELECT doc_id, source, size, count(*) AS n, md5(concat('mix|', coalesce(CAST(doc_id AS VARCHAR), ''), '|', size)) AS h
  FROM (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents) GROUP BY ALL),
s AS (
  SELECT source, CAST(sum(size * n) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM u GROUP BY source),
r AS (
  SELECT 0 AS k, CAST(sum(source_size) AS BIGINT) AS rest, CAST(sum(weight) AS BIGINT) AS w, CAST(sum(source_size) AS BIGINT) AS whole, 0 AS capped FROM s
  UNION ALL
  SELECT r.k + 1, CAST(r.whole - sum(CASE WHEN s.weight * r.rest / r.w > 3 * s.source_size THEN 3 * s.source_size ELSE 0 END) AS BIGINT),
         CAST(sum(CASE WHEN s.weight * r.rest / r.w > 3 * s.source_size THEN 0 ELSE s.weight END) AS BIGINT), r.whole,
         count(*) FILTER (WHERE s.weight * r.rest / r.w > 3 * s.source_size)
  FROM r, s WHERE r.w > 0 GROUP BY r.k, r.whole, r.capped
  HAVING count(*) FILTER (WHERE s.weight * r.rest / r.w > 3 * s.source_size) > r.capped),
t AS (
  SELECT s.*, CASE WHEN weight * e.rest / e.w > 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE weight * e.rest / e.w END AS target,
         (2 * e.whole + {block}) // {2 * block} AS total, greatest(1, CAST(ceil(source_size / {shard}) AS BIGINT)) AS shards
  FROM s, (SELECT * FROM r ORDER BY k DESC LIMIT 1) e),
q AS (
  SELECT src, row_number() OVER (ORDER BY target / (2 * seat - 1) DESC, src) AS place, total
  FROM (SELECT src, target, total, unnest(range(1, CAST(2 * target / {block} AS BIGINT) + 100)) AS seat FROM t WHERE target > 0)),
v AS (SELECT src, count(*) AS seats FROM q WHERE place <= total GROUP BY src),
d AS (
  SELECT u.*, t.src, t.source_size, t.target, CAST('0x' || substr(h, 1, 8) AS BIGINT) % t.shards AS shard
  FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source),
g AS (
  SELECT src, shard, CAST(sum(size * n) AS BIGINT) AS words, greatest(1, CAST(floor(sum(size * n) / {block} + 0.5) AS BIGINT)) AS blocks FROM d GROUP BY src, shard),
p AS (
  SELECT src, shard, row_number() OVER (PARTITION BY src ORDER BY words / (2 * seat - 1) DESC, shard) AS place
  FROM (SELECT src, shard, CAST(words AS DOUBLE) AS words, unnest(range(1, 4 * blocks + 100)) AS seat FROM g WHERE words > 0)),
o AS (SELECT p.src, p.shard, count(*) AS seats FROM p JOIN v USING (src) WHERE p.place <= v.seats GROUP BY p.src, p.shard),
x AS (SELECT g.*, least(coalesce(o.seats, 0), 3 * blocks) AS quota FROM g LEFT JOIN o USING (src, shard)),
b AS (
  SELECT src, shard, j * words // blocks AS b0, (j + 1) * words // blocks AS b1
  FROM (SELECT *, row_number() OVER (PARTITION BY src, shard ORDER BY md5(concat('mix|', src, '|', shard, '|', j))) AS place
        FROM (SELECT *, unnest(range(0, blocks)) AS j FROM x))
  WHERE place <= quota % blocks),
z AS (
  SELECT *, w0 + i * size AS a0 FROM (
    SELECT *, sum(size * n) OVER (PARTITION BY src, shard ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size * n AS w0, unnest(range(0, n)) AS i FROM d))
SELECT z.doc_id, z.size, z.source_size, z.target, CAST(z.size * (any_value(x.quota) // any_value(x.blocks)) + coalesce(sum(least(z.a0 + z.size, b.b1) - greatest(z.a0, b.b0)) FILTER (WHERE b.b0 IS NOT NULL), 0) AS BIGINT) AS taken
FROM z JOIN x USING (src, shard) LEFT JOIN b ON b.src = z.src AND b.shard = z.shard AND b.b0 < z.a0 + z.size AND b.b1 > z.a0
GROUP BY z.doc_id, z.size, z.source_size, z.target, z.a0, z.i, z.src, z.shard, z.h
"""


OP13_SQL = mixing_sql()
