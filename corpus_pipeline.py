"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharpfleet.llm.decontaminate import drop_leaked
from sharpfleet.llm.lines import drop_lines
from sharpfleet.llm.neardup import near_duplicates
from sharpfleet.llm.packing import pack
from sharpfleet.llm.quality import fit_documents, held_out, score_documents
from sharpfleet.llm.store import Store

ORACLE_SQL = None  # learned scores, sketches and token ids have no SQL form; tests/llm compares with brute force


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more, by a model fitted on the labelled rows among them."""
    model = fit_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", ~held_out(5, 0))
    return score_documents(docs, model).filter("score >= 0.3").select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of 40 characters or more that stand in five documents or more (the last keeps them)."""
    return drop_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document of the smallest id."""
    gone = near_duplicates(docs).filter("doc_id <> class_id").select("doc_id")
    return docs.hint("merge").join(gone, "doc_id", "left_anti").select(*docs.columns)  # one plan at every size


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no stretch of a benchmark item."""
    return drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, placed in sequences of 1024."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality", good),
    ("lines", without_repeated_lines),
    ("near_duplicates", one_of_each_class),
    ("decontamination", without_benchmark),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again."""
    docs, store = spark.read.parquet(f"{sf_dir}/documents.parquet"), Store(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = store.put(stage(spark, docs, sf_dir), name)
        if i:
            store.drop(STAGES[i - 1][0])
    return docs
