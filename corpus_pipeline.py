"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Stages get (spark, docs, sf_dir). All but the last return the columns of documents. A row is judged by its own text: rows of one doc_id
with different texts are different documents and share no verdict; of equal rows (as of any group of near duplicates) one stays; a row without
doc_id gives way to numbered ones of its group. Null and empty texts, and texts of any length, pass every stage; extra columns, whatever
their names, are kept. An empty table gives an empty result. n_chars of a shortened text is counted again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from curvemill.llm.bpe import encode_decode
from curvemill.llm.decontaminate import decontaminated
from curvemill.llm.lines import dedup_lines
from curvemill.llm.ngram_join import one_of_each
from curvemill.llm.queries import TOKENIZER
from curvemill.llm.shared import table
from curvemill.llm.toxicity import learn, without_toxic


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    return without_toxic(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a host go; documents stay."""
    return dedup_lines(docs)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest doc_id stays."""
    return one_of_each(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return encode_decode(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", stage_toxicity),
    ("line_dedup", stage_lines),
    ("ngram_join", stage_near_duplicates),
    ("decontaminate", stage_decontaminate),
    ("bpe", stage_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The learned toxicity stage has no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None
