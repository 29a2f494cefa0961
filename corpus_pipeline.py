"""A training corpus from raw documents: five stages, each an operator of ``tidepool.llm``.

A stage is a function of (spark, docs, sf_dir). Its result is written as Parquet
below the session's shared folder and read again as the next stage's ``docs``.
All but the last return the columns of ``documents``, and any others that came
along, whatever their names.

Edge cases of the stages: null texts are empty; null, repeated and equal ids are
rows like others; rows that are equal throughout may be told apart by nothing,
so any one of them is kept where one is; an empty table passes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepool.llm import decontaminate, mixing, ngram_join, token_store, toxicity
from tidepool.llm.common import scratch, table
from tidepool.llm.queries import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model is trained on the labels that the table comes with. Without labels of both kinds none goes; texts are scored whole."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of n-gram Jaccard links stays, that with the least id, then text digest; null ids come last. Documents without words are one class."""
    return ngram_join.one_of_each_class(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go; an empty benchmark, and items without words, leave all."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one without words is taken as its source's other rows are. A null source is a source."""
    return mixing.apply_mix(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store of what is left, read back: one row per document that was written, repeats too, null ids first."""
    return token_store.token_ids(docs, tokenizer_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]

#: Toxicity and the token ids have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
