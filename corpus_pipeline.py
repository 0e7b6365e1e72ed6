"""A corpus cleaning pipeline over the ``documents`` table: five stages, each one operator.

Every stage but the last returns the columns of its input.  Each one works on all
that the stage before kept: documents without a main language go, then all but the
smallest id of each group of near duplicates, then byte strings that an earlier text
holds, then documents with a benchmark passage; what remains is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.decontamination import drop_contaminated
from quantloom.llm.language_id import keep_told
from quantloom.llm.ngram_join import keep_one
from quantloom.llm.packing import pack
from quantloom.llm.suffix_dedup import remove_repeats


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a main language go; ``lang`` becomes the inferred one."""
    return keep_told(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated strings; documents of which only white space remains go."""
    return remove_repeats(docs).where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("decontaminate", decontaminate), ("packing", packing)]

#: Components, mixtures and packing are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents`` in order, each on the written table of the one before."""
    from quantloom.llm.common import Stage

    written = Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written.write(docs, name)
    return docs
