"""Licence texts in documents by diagonal voting.

All runs of K consecutive words of a document are joined, by hash, to the places where they stand in the templates (a
template of fewer words is one run). A match votes for its diagonal, the difference of the two places; diagonals next
to each other are merged, and a merged span is verified: it is no longer than the template and ``DRIFT`` words, each
place of the template counts once and each word of the document backs one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
K = 3
DRIFT = 8  # diagonals of one span differ by at most so many words
COVER = 0.5  # share of a template's runs that a span must hold

# fixed values: phrases whose places are counted, with their labels
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
# fixed values: sentences of public licences
SENTENCES = [
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
]


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased and no other letter."""
    text = F.coalesce(text, F.lit(""))
    small = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.regexp_extract_all(small, F.lit(WORD), 0)


def _runs(size: int) -> Column:
    """(position, hash) of all runs of ``size`` of the column ``words``."""
    last = F.size("words") - size
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice("words", i + 1, size)).alias("run")))


def _short_runs(size: int, firsts: list[str]) -> Column:
    """As ``_runs``, only where the first word begins a template of ``size`` words."""
    last = F.size("words") - size
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    at = F.filter(at, lambda i: F.element_at("words", i + 1).isin(firsts))
    return F.transform(at, lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice("words", i + 1, size)).alias("run")))


def templates(spark: SparkSession) -> tuple[DataFrame, dict[int, list[str]]]:
    """Rows (template, label, base, runs, place, run) of all templates, and first words of those shorter than K."""
    rows = [(i, label, i < len(PHRASES), text) for i, (label, text) in enumerate(PHRASES + SENTENCES)]
    short = {}
    for _, _, _, text in rows:
        w = text.split()
        if len(w) < K:
            short.setdefault(len(w), []).append(w[0])
    t = spark.createDataFrame(rows, "template int, label string, base boolean, text string").withColumn("words", words(F.col("text")))
    parts = [t.filter(F.size("words") >= K if n == K else F.size("words") == n).withColumn("r", F.explode(_runs(n))).withColumn("long", F.lit(n)) for n in (*sorted(short), K)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    count = F.greatest(F.size("words") - F.col("long") + 1, F.lit(1)).alias("runs")
    return out.select("template", "label", "base", count, F.size("words").alias("length"), F.col("r.at").alias("place"), F.col("r.run").alias("run")), short


# Equal rows of one input partition are one group; the partition keeps many equal rows, or rows without an id, apart.
KEY = ["_doc", "_text", "_part"]


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words) of every document, with a row per verified span: template, label, base, votes, cover, first, last, end (places of words).

    ``votes`` are the distinct runs of the template in the span, ``cover`` their share of all its runs. Of spans of one
    template whose diagonals differ by ``DRIFT`` or less the best stays, the first of equal ones; base phrases all stay.
    Every group of equal rows (doc_id, text) of a partition also has one row for itself, where template and label are
    null and ``votes`` is the number of its rows. Null texts count as empty; ids may be null or repeat.
    """
    spark = docs.sparkSession
    table, short = templates(spark)
    d = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"), F.spark_partition_id().alias("_part"), words(F.col("text")).alias("words"))
    runs = F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).cast("long").alias("run"))), *[_short_runs(n, f) for n, f in sorted(short.items())], _runs(K))
    # the row at -1 stands for the document itself, so that one pass yields its words and its matches
    d = d.select(*KEY, F.size("words").cast("long").alias("n_words"), F.explode(runs).alias("r")).select(*KEY, "n_words", "r.at", "r.run")
    own = spark.createDataFrame([(None, None, None, 1, 0, -1, 0)], "template int, label string, base boolean, runs int, length int, place int, run long")
    hits = d.join(F.broadcast(table.union(own)), "run")  # the templates are the few above
    diagonal = (F.col("at") - F.col("place")).alias("diagonal")
    votes = hits.groupBy(*KEY, "template", "label", "base", "runs", "length", diagonal).agg(
        F.count("*").alias("rows"), F.collect_set("place").alias("places"), F.max("n_words").alias("n_words"))
    w = Window.partitionBy(*KEY, "template").orderBy("diagonal")
    after, around = w.rangeBetween(0, DRIFT), w.rangeBetween(-DRIFT, DRIFT)
    both = F.array_distinct(F.flatten(F.collect_list("places").over(after)))
    ats = F.array_distinct(F.flatten(F.collect_list(F.transform("places", lambda p: p + F.col("diagonal"))).over(after)))
    v = votes.withColumns({"_places": both, "_ats": ats})
    backed = F.least(F.size("_places"), F.size("_ats"))
    v = v.withColumn("votes", F.when(F.col("template").isNull(), F.col("rows")).when(F.col("base"), F.lit(1)).otherwise(backed).cast("long"))
    mine = F.struct(F.col("votes").alias("n"), (-F.col("diagonal")).alias("early"))
    v = v.withColumn("_best", F.max(mine).over(around))
    v = v.filter(F.col("template").isNull() | F.col("base") | (F.col("_best") == mine))
    at = F.when(F.col("base"), F.array("diagonal")).otherwise(F.col("_ats"))
    size = F.least(F.col("length"), F.lit(K))
    return v.withColumn("_at", at).select(
        *KEY, F.col("_doc").alias("doc_id"), "n_words", "template", "label", "base", "votes", F.when(F.col("template").isNotNull(), F.col("votes") / F.col("runs")).alias("cover"),
        F.array_min("_at").alias("first"), F.array_max("_at").alias("last"), (F.array_max("_at") + size).alias("end"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts and places of the base phrases, labels, and the best cover of a template as score."""
    s = spans(docs)
    base, found = F.col("base"), F.col("label").isNotNull() & (F.col("cover") >= COVER)
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    groups = s.groupBy(*KEY).agg(
        F.max("n_words").alias("n_words"), F.coalesce(F.sum(F.when(base, F.col("votes"))), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("last"))).cast("long").alias("last_word"),
        names(base).alias("base_labels"), names(base | found).alias("labels"),
        F.coalesce(F.max(F.when(F.col("label").isNotNull(), F.col("cover"))), F.lit(0.0)).alias("score"),
        F.max(F.when(F.col("template").isNull(), F.col("votes"))).alias("_rows"))
    each = F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int")))
    return groups.withColumn("_row", each).select(F.col("_doc").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
