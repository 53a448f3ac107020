"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharpfleet.llm.store import Store


def _between(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def components(edges: DataFrame, store: Store, name: str) -> DataFrame:
    """(node, label) for every end of a link (a, b): label is the smallest node that it is connected with.

    A round points every node to its smallest neighbour, and once more to that one's, then contracts the graph: links
    between the targets remain, those inside a target go. Stars and groups of copies vanish in the first round, chains
    shorten by a factor in each, and the table of links shrinks with them. States are tables of the store.
    """
    ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    state = store.put(ends.withColumn("label", F.col("node")), f"{name}-state-0")
    links = store.put(edges.select(*_between("a", "b")).filter("a < b").distinct(), f"{name}-links-0")
    for i in range(1, 10_000):
        if links.isEmpty():
            return state
        near = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        low = store.put(near.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("low")), f"{name}-low")
        far = low.join(low.select(F.col("node").alias("low"), F.col("low").alias("far")), "low").select("node", "far")
        far = store.put(far, f"{name}-far")
        moved = state.join(far.select(F.col("node").alias("label"), "far"), "label", "left").select("node", F.coalesce("far", "label").alias("label"))
        left = links.join(far.select(F.col("node").alias("a"), F.col("far").alias("x")), "a").join(far.select(F.col("node").alias("b"), F.col("far").alias("y")), "b")
        state = store.put(moved, f"{name}-state-{i}")
        links = store.put(left.select(*_between("x", "y")).filter("a < b").distinct(), f"{name}-links-{i}")
        store.drop(f"{name}-low", f"{name}-far", f"{name}-state-{i - 1}", f"{name}-links-{i - 1}")
    raise RuntimeError("labels did not settle")
