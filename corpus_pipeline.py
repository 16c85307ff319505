"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. Results are
written as Parquet to the shared folder and read again as the next stage's documents. All
stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ontide.llm import bpe, decontaminate, pii, prefix_tree_join, quality_rules
from ontide.llm.common import table
from ontide.llm.queries import WORD_BPE, tokenizer_path
from ontide.session import stage

OTHERS = ["lang", "source"]
NEAR = prefix_tree_join.JoinParams(percent=80, width=5)


def documents(rows: DataFrame, text: str) -> DataFrame:
    """The columns of documents with `text` as text."""
    size = F.length(text).cast("bigint").alias("n_chars")
    return rows.select("doc_id", F.col(text).alias("text"), *OTHERS, size)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that failed."""
    rows = quality_rules.clean_documents(docs, carry=OTHERS)
    return documents(rows.filter("kept"), "cleaned_text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: sets of five-word shingles with a
    similarity of 0.8 or more."""
    return prefix_tree_join.one_per_component(docs, NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    benchmark = table(spark, sf_dir, "benchmark")
    rows = decontaminate.find_leaks(docs, benchmark, keep_text=True, carry=OTHERS)
    return documents(rows.filter(F.size("spans") == 0), "text")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each personal datum replaced by its kind."""
    return documents(pii.find_personal_data(docs, with_masked=True, carry=OTHERS), "masked")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids per document, with digests of the ids and of the text decoded from them."""
    return bpe.token_digests(docs, bpe.read_spec(tokenizer_path(WORD_BPE)), with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("BPE encoding and decoding", tokens),
]

# SQL can express neither the masking of disguised data nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, function in STAGES:
        docs = stage(function(spark, docs, sf_dir))
    return docs
