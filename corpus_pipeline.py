"""Clean a corpus in five stages, each written and read again by whoever runs them one by one.

Quality rules drop documents that fail the policy; of each group of near duplicates the document with the least id
stays; documents that hold a benchmark window go; personal data is replaced by pseudonyms; texts become token ids.
All stages but the last return the columns of ``documents``.

The key of the pseudonyms is a setting of the session (``registry.KEY_SETTING``); without one the public ``registry.TEST_KEY`` is used,
with a warning.

Defined results in every stage: columns that clash with those of an operator keep their values; very long texts are treated
whole; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import decontaminate, jaccard, piece_codec, pseudonyms, quality
from panelwright.llm._store import keep
from panelwright.llm.registry import pseudonym_key, tokenizer

POLICY = "web-1"
#: Contaminated documents are broadcast up to this count, 16 bytes each.
BROADCAST_ROWS = 1_000_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the policy.  A null text has too few words; repeated rows are judged one by one."""
    # the row is packed away, so a column that is named like a measurement keeps its values
    judged = quality.apply_policy(quality.ledger(docs.select("text", F.struct("*").alias("__pw_row"))), POLICY)
    return judged.where("kept").select("__pw_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the least id, and of several texts of that id the one whose hash is least.

    Rows with a null id and texts without words belong to no class and stay; repeated rows of a document fold to one.
    """
    return jaccard.representatives(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window.  A row is judged by its id and text, null ids and repeated rows included."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(docs, items).where("contaminated")
    found = keep(found.select(F.col("doc_id").alias("__pw_doc"), F.col("text_key").alias("__pw_text")).distinct(), "contaminated")
    few = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    same = F.col("doc_id").eqNullSafe(F.col("__pw_doc")) & (F.xxhash64("text") == F.col("__pw_text"))
    return docs.join(F.broadcast(found) if few else found, same, "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data; ``n_chars`` follows the text.  Null texts stay null, all rows stay."""
    return pseudonyms.n_chars(pseudonyms.apply(docs, pseudonym_key(spark), counts=False)).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, and the text that they decode to, of every row; a null text has no ids and decodes to nothing."""
    return piece_codec.encode(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark passages", benchmark_passages),
    ("personal data", personal_data),
    ("token ids", token_ids),
]

#: The near-duplicate join, the pseudonyms and the tokenizer have no SQL form; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written to the shared folder before the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = keep(docs, f"pipeline-{i}")
    return docs
