"""A corpus pipeline: toxicity, near duplicates, benchmark decontamination, mixing, token files.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. Each stage's result is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import decontaminate, mixing, ngram_join, queries, token_store, toxicity
from codeloom.llm.common import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that toxicity scoring does not reject; each row by its own text, null and empty ones and rows that repeat too. An empty table gives none; columns may have any names."""
    return toxicity.filter_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents, the row with the least doc_id (null first), then the least digest of its text; of rows that repeat, one. Texts without words all stay. An empty table gives none; columns may have any names."""
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark passage; each row by its own text, so that null ids and rows that repeat play no part. Null and empty texts stay. An empty table or benchmark drops nothing; columns may have any names."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them: a null source is a source, a null doc_id a document, rows that repeat are interchangeable. An empty table gives none; columns may have any names."""
    return mixing.mix(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row, from token files written and read back: a null or empty text has the end id alone, a null doc_id comes first, rows that repeat stand together. An empty table gives none; other columns are ignored."""
    return token_store.token_digest(docs, queries.tokenizer_config())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_similar),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_token_files),
]

#: No stage but mixing can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
