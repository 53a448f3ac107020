"""Removal of repeated lines with levelled sorted runs of line hashes.

A run is a table of line keys, sorted and spread by hash: how many documents hold the line, and the largest of their
ids. Batches of documents arrive one after another. A batch merge-anti-joins the runs, so that keys new to the store
form its own run of level 0, and known keys add a run of increments; ``fanout`` runs of one level are compacted into
one of the next, so a key is rewritten only as often as there are levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharpfleet.llm.store import Store

BLANK = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_keys(docs: DataFrame, least: int = 40) -> DataFrame:
    """Distinct (doc_id, k1, k2): two hashes of each line key of at least ``least`` code points. Null texts have one empty line."""
    line = F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("_l")
    key = F.translate(F.btrim("_l", F.lit(BLANK)), UPPER, UPPER.lower())
    keys = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", line).select("doc_id", key.alias("_k")).filter(F.char_length("_k") >= least)
    return keys.select("doc_id", F.xxhash64("_k").alias("k1"), F.xxhash64(F.lit(7), F.col("_k")).alias("k2"))


class LineRuns:
    """The store of runs. ``levels[i]`` lists the runs of level i; reading merges them, sums of counts and largest ids."""

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.store, self.fanout, self.levels, self.made = Store(spark), fanout, [[]], 0

    def _write(self, rows: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        name, self.made = f"run{self.made}", self.made + 1
        self.store.put(rows.sortWithinPartitions("k1", "k2"), name)
        self.levels[level].append(name)

    def _read(self, names: list[str]) -> DataFrame | None:
        tables = [self.store.spark.read.schema("k1 long, k2 long, n long, last long").parquet(*map(self.store.path, names))] if names else []
        return tables[0] if tables else None

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, keys: DataFrame) -> None:
        """Take in a batch of distinct (doc_id, k1, k2). A document belongs to one batch."""
        own = keys.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
        before = self._read(self.names())
        if before is not None:
            seen = before.select("k1", "k2").distinct().withColumn("_old", F.lit(True))
            own = own.join(seen, ["k1", "k2"], "left")
            name = f"batch{self.made}"
            own = self.store.put(own, name)
            self._write(own.filter("_old is null").drop("_old"), 0)
            if not (again := own.filter("_old").drop("_old")).isEmpty():
                self._write(again, 0)
            self.store.drop(name)
        else:
            self._write(own, 0)
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                old, self.levels[level] = self.levels[level], []
                self._write(self._merged(self._read(old)), level + 1)
                self.store.drop(*old)
            level += 1

    def merged(self) -> DataFrame:
        """One row per key ever added: k1, k2, n, last."""
        rows = self._read(self.names())
        return self._merged(rows if rows is not None else self.store.spark.createDataFrame([], "k1 long, k2 long, n long, last long"))


def collect_runs(docs: DataFrame, batches: int = 4, least: int = 40) -> LineRuns:
    """Runs over all documents, added in ``batches`` batches by hash of the id. The keys are taken from the texts once."""
    runs = LineRuns(docs.sparkSession)
    keys = line_keys(docs, least).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    keys = runs.store.put(keys, "keys", "batch")
    for b in range(batches):
        runs.add(keys.filter(F.col("batch") == b).drop("batch").distinct())
    return runs


def drop_lines(docs: DataFrame, least: int = 40, copies: int = 5, batches: int = 4) -> DataFrame:
    """``docs`` without repeated lines, and ``n_lines`` (before), ``n_dropped``.

    A line whose key (blanks stripped, A-Z lower-cased) has ``least`` code points or more and stands in ``copies``
    documents or more stays only in the document of the largest id. Null or empty texts are one empty line. Rows
    without an id are kept as they are and not counted; equal rows of one id count as one document.
    """
    runs = collect_runs(docs, batches, least)
    common = runs.store.put(runs.merged().filter(F.col("n") >= copies).select("k1", "k2", "last"), "common")
    runs.store.drop(*runs.names())
    keys = runs.store.spark.read.schema("doc_id long, k1 long, k2 long").parquet(runs.store.path("keys"))
    goes = keys.join(common, ["k1", "k2"]).filter("doc_id < last").groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("_go"))
    goes = runs.store.put(goes, "goes")
    runs.store.drop("keys", "common")
    stripped = F.transform(
        F.split(F.coalesce("text", F.lit("")), "\n", -1),
        lambda x: F.struct(x.alias("line"), F.translate(F.btrim(x, F.lit(BLANK)), UPPER, UPPER.lower()).alias("key")))
    kept = F.transform(
        F.filter(stripped, lambda x: ~((F.char_length(x["key"]) >= least) & F.array_contains(
            F.col("_go"), F.struct(F.xxhash64(x["key"]).alias("k1"), F.xxhash64(F.lit(7), x["key"]).alias("k2"))))), lambda x: x["line"])
    # the user's columns travel in one, so that no name of theirs meets one of these
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    out = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in columns if c not in ("doc_id", "text")], F.lit(0).alias(_fresh(columns))).alias("_user"))
    out = out.hint("merge").join(goes, "doc_id", "left")  # one plan at every size
    lines = F.when(F.col("_go").isNull(), F.split(F.coalesce("text", F.lit("")), "\n", -1)).otherwise(kept)
    out = out.withColumn("_kept", lines).withColumn("n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long"))
    out = out.withColumn("n_dropped", F.col("n_lines") - F.size("_kept")).withColumn("text", F.when(F.col("_go").isNull(), F.col("text")).otherwise(F.array_join("_kept", "\n")))
    return out.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_user").getField(c).alias(c) for c in columns], "n_lines", "n_dropped")


def _fresh(names: list[str]) -> str:
    """A name that is none of ``names``."""
    name = "_none"
    while name in names:
        name += "_"
    return name


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM d),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, k.i, k.line, coalesce(k.doc_id < c.last, false) AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
