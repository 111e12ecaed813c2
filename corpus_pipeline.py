"""The corpus pipeline: reject toxic documents, keep one of each near-duplicate group, drop documents that hold benchmark
items, mix the sources and write token files.

Each stage takes (spark, docs, sf_dir) and works on what the stage before kept; all but the last return the columns of docs.
Null and empty texts are kept by the first three stages (empty texts are nobody's near-duplicates). Rows that repeat a doc_id
with other texts are documents of their own; of rows that repeat doc_id and text the second stage keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import load, stage
from tidemark.llm.decontaminate import with_matches
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.ngram_jaccard import one_of_each_group
from tidemark.llm.token_files import token_files
from tidemark.llm.toxicity import learn, with_score

TOXIC = 0.7


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = learn(docs, load(spark, sf_dir, "labels"), folds=False)
    return with_score(docs, model, "_tidemark_score").filter(F.col("_tidemark_score") < TOXIC).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs, n=5, num=80, den=100)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = with_matches(docs, load(spark, sf_dir, "benchmark"), "_tidemark_matches")
    return found.filter(F.size("_tidemark_matches") == 0).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
    ("token_files", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages learn models, so SQL cannot express them; tests compare them with brute force.
ORACLE_SQL = None
