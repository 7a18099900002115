"""From raw documents to packed token sequences, in five stages.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their
columns; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.llm.common import read_table, staged
from tabspark.llm.jaccard_join import keep_one_of_each
from tabspark.llm.language import keep_identified, learn_languages
from tabspark.llm.line_runs import delete_repeated_lines
from tabspark.llm.mixing import mix_sources
from tabspark.llm.packing import pack_documents
from tabspark.llm.registry import query


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; dictionaries come from their own labels."""
    return keep_identified(docs, learn_languages(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of runs of 50 words or more.

    ``n_chars`` follows the text. Documents that are nothing but such copies go;
    texts that were null or empty before stay.
    """
    kept = delete_repeated_lines(docs, deleted="deleted_lines")
    changed = F.size("deleted_lines") > 0
    out = kept.where(~F.coalesce(changed, F.lit(False)) | (F.trim("text") != ""))
    n_chars = F.when(changed, F.length("text")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words at 0.8."""
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated so that all sources weigh the same, in global hash order."""
    return mix_sources(docs, extras=False)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens."""
    return pack_documents(docs)


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: token ids and similarity components have no SQL form; tests compare with brute force
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read by the next."""
    docs = read_table(spark, sf_dir, "documents")
    *filters, (_, last) = STAGES
    for name, stage in filters:
        docs = staged(stage(spark, docs, sf_dir), name)
    return last(spark, docs, sf_dir)
