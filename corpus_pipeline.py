"""From raw documents to token ids: quality rules, near-duplicates, secrets, source mix, BPE.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns a DataFrame; all but
the last return the columns of ``documents``. Between stages the rows are written as Parquet and read again.

1. ``quality``: documents that a production rule fails are dropped.
2. ``near_dedup``: one document of each class of near-duplicates stays.
3. ``secrets``: secrets in texts are replaced by a mark; no document is dropped.
4. ``mix``: sources are brought to their target weights; a document appears as often as the mix takes it.
5. ``bpe``: doc_id, source, lang, token ids, their number, and digests of the ids and of the text decoded from them.

Rows with null or empty texts fail the first stage; an empty table stays empty throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import bpe, minhash, mixing, quality, secrets
from tesserae.llm._common import materialize, release, scratch
from tesserae.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the policy prod-1. Null, empty and blank texts fail it; long texts are measured whole.

    Rows stand alone, so repeats stay or go together; columns are kept as they are, whatever they are called.
    """
    return quality.keep_good(docs, "prod-1")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near-duplicates: the one with the smallest doc_id (null ids last), once if it is repeated.

    Texts without a word are in no class and stay.
    """
    return minhash.keep_one_of_each(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every span of the secret scan replaced by a mark and n_chars counted again; null texts stay null."""
    return secrets.redact_secrets(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, 0 to 3 times. A null source is a source of its own; texts without words come
    with whole epochs only."""
    return mixing.mixed_rows(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text and the digests of the round trip, one row per row; a null or empty text has no ids."""
    return bpe.round_trip(docs, tokenizer_path("byte_bpe_50k.json"), keep=("doc_id", "source", "lang"), ids=True)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("mix", mix_stage),
    ("bpe", bpe_stage),
]

#: Signatures, weighted sampling by hash and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's intermediate tables, and its input if a stage wrote it, go once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as keep:
        for name, stage in STAGES[:-1]:
            with scratch(spark) as keep_stage:
                made = keep_stage(materialize(stage(spark, docs, sf_dir), f"stage-{name}"))
            release(docs)
            docs = made
        return STAGES[-1][1](spark, keep(docs), sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {}
