"""Document fingerprints by winnowing, in column expressions only.

A text is a row of words; rolling hashes cover K consecutive words, and of every window of W consecutive hashes the
smallest is kept with its position (the rightmost of equal ones). Texts that share K + W - 1 words in a row share a
fingerprint entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sharpfleet.llm.store import Store

K, W = 4, 4  # powers of two: hashes and minima are put together by doubling


def _shifted(a: Column, by: int) -> Column:
    return F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0)))


def winnow(d: DataFrame, text: str, out: str) -> DataFrame:
    """``d`` with ``out``: array of longs, hash * 2^31 + (2^31 - 1 - position in words), in order of position.

    A null or empty text is one empty word. A text of fewer than K words has one hash of all of them, one of fewer than
    K + W - 1 words one window. Every step is a column of its own, as it is used more than once.
    """
    d = d.withColumn(out, F.transform(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: F.xxhash64(w)))
    step = 1
    while step < K:
        d = d.withColumn(out, F.zip_with(out, _shifted(F.col(out), step), lambda a, b: F.xxhash64(a, b)))
        step *= 2
    whole = F.slice(out, 1, F.greatest(F.size(out) - (K - 1), F.lit(1)))
    d = d.withColumn(out, F.transform(whole, lambda x, i: F.shiftleft(x.bitwiseAND(F.lit(0xFFFFFFFF)), 31) + (F.lit((1 << 31) - 1) - i)))
    step = 1
    while step < W:
        d = d.withColumn(out, F.zip_with(out, _shifted(F.col(out), step), lambda a, b: F.least(a, b)))
        step *= 2
    return d.withColumn(out, F.array_distinct(F.slice(out, 1, F.greatest(F.size(out) - (W - 1), F.lit(1)))))


def hashes(fingerprint: Column) -> Column:
    """The distinct 32-bit hashes of a fingerprint, without positions."""
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftrightunsigned(x, 31) - F.lit(1 << 31)).cast("array<int>"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of hashes."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def as_text(fingerprint: Column) -> Column:
    """Digest of hashes and positions."""
    return F.md5(F.array_join(fingerprint.cast("array<string>"), ",").cast("binary"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (array of hash and position) of every document."""
    entry = F.transform("own", lambda x: F.struct(F.shiftrightunsigned(x, 31).alias("hash"), (F.lit((1 << 31) - 1) - x.bitwiseAND(F.lit((1 << 31) - 1))).alias("position")))
    return winnow(docs.select("doc_id", "text"), "text", "own").select("doc_id", entry.alias("fingerprint"))


# a document is told by its id (a null one comes after all others), whether it is null, and a hash of its text
KEY = ["_id", "_null", "_hash"]


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id"), F.col("doc_id").isNull().alias("_null"), F.xxhash64(text).alias("_hash"), text.alias("text"))


def next_keys(keys: DataFrame, store: Store) -> DataFrame:
    """``keys``, distinct, with the key of the next smaller one as next_*; for the smallest the largest. Keys are ranged over partitions; only the ends of ranges meet."""
    order = [F.col("_id"), F.col("_null").desc(), F.col("_hash")]
    keys = keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    keys = store.put(keys.withColumn("_key", F.struct("_id", (~F.col("_null")).alias("known"), "_hash")), "ids")
    ends = keys.groupBy("part").agg(F.min("_key").alias("lo"), F.max("_key").alias("hi"))
    w = Window.orderBy("lo")
    below = ends.select("part", F.coalesce(F.lag("hi").over(w), F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("below"))
    inner = keys.withColumn("next", F.lag("_key").over(Window.partitionBy("part").orderBy("_key")))
    after = F.coalesce("next", "below")
    return inner.join(below, "part").select(*KEY, "third", after["_id"].alias("next_id"), (~after["known"]).alias("next_null"), after["_hash"].alias("next_hash"))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Per row: its fingerprint, that of its edited text, and their likeness, and the likeness to the next document.

    The edited text has the last third of the code points replaced by as many from the start of the next document (by
    descending id; after the last the first). Null texts count as empty. Rows of equal id and text are one document and
    each has its result; texts that share an id stand in the order of their hashes, those without an id come last.
    """
    store = Store(docs.sparkSession)
    base = keyed(docs)
    keys = base.select(*KEY, F.floor(F.char_length("text") / 3).cast("int").alias("third")).groupBy(*KEY).agg(F.max("third").alias("third"))
    need = store.put(next_keys(keys, store), "need")
    # equal rows lie side by side in the order that the join needs anyway; the first of them serves
    first = F.lag(F.lit(1)).over(Window.partitionBy(*KEY).orderBy("_hash")).isNull()
    one = base.withColumn("_first", first).filter("_first").drop("_first")
    after = need.select(*[F.col(k).alias(f"for{k}") for k in KEY], "third", *[F.col(f"next{k}").alias(k) for k in KEY]).hint("merge").join(one, KEY)
    after = winnow(after.select(*[F.col(f"for{k}").alias(k) for k in KEY], "third", F.substring("text", F.lit(1), F.col("third")).alias("tail"), "text"), "text", "after").drop("text")
    after = after.select(*KEY, "third", "tail", hashes(F.col("after")).alias("after"))
    d = base.hint("merge").join(after, KEY).withColumn("n_chars", F.char_length("text").cast("long"))
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - F.col("third")), F.col("tail"))).drop("tail", "third")
    d = winnow(winnow(d, "text", "own"), "edited", "new").withColumns({"h": hashes(F.col("own")), "g": hashes(F.col("new"))})
    return d.select(
        F.when(~F.col("_null"), F.col("_id")).alias("doc_id"), "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"), as_text(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("h"), F.col("g")).alias("near_edited"), likeness(F.col("h"), F.col("after")).alias("near_next"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
