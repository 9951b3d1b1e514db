"""A corpus pipeline of five stages; each works on all that the stage before it kept.

Rows are judged one by one, so a null or repeated doc_id loses no other row: near-dedup drops
rows alike by its rule only, decontamination looks at each row's own text. Null and empty
texts fail the quality rules. Extra columns pass through to the last stage; an empty table
gives an empty result at every stage.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result
as Parquet in the shared folder and rereads it as the next stage's docs. All stages but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cytomesh.llm import decontaminate, near_dedup, packing, pii, quality
from cytomesh.session import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the log-likelihood ratio keep."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest doc_id."""
    return near_dedup.survivors(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data generalised and words that disclose it removed."""
    return pii.sanitize(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, packing.tokenizer_path(packing.TOKENIZER))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("packing", pack),
]

#: Tokenising has no SQL form; tests/llm/ compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
