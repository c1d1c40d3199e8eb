"""The queries of this subpackage: one per operator, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import bpe, classifier, html, minhash, mixing, oracles, quality, rollup, secrets, sharding, topk
from tesserae.llm._common import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabulary files lie; callers of the operators pass any other path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: page_id, url, text, n_chars. A null page or one without main text has an empty text."""
    return html.extract(table(spark, sf_dir, "pages"))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens and the digests of its ids and of the text decoded from them; a null text counts as empty."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer version after five batches over all documents.

    Both versions enter; one batch comes twice; the first source (by code point) is withdrawn; what is left of the first version
    is counted again with a begin and an end token each.
    """
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    old, new = "byte_bpe_50k", "byte_bpe_multi_50k"
    versions = {v: public_tokenizers.path(f"{v}.tiktoken") for v in (old, new)}
    counts = materialize(rollup.count_tokens(docs, versions, public_tokenizers.PATTERN), "counts")
    version = lambda v: counts.filter(F.col("tokenizer") == v)
    first_source = docs.agg(F.min("source")).first()[0]
    left = version(old).filter(~F.col("source").eqNullSafe(F.lit(first_source)))
    batches = [
        ("second-version", rollup.inserts(version(new))),
        ("withdraw", rollup.deletes(counts.filter(F.col("source") == first_source))),
        ("second-version", rollup.inserts(version(new))),
        ("recount", rollup.revisions(left, left.withColumn("n_tokens", F.col("n_tokens") + 2))),
    ]
    return rollup.load(spark, version(old), "token-counts", batches).totals()


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, size, text_crc32 and its shard and slot by the law rows; a null text has size 1."""
    dealt = sharding.shard_rows(table(spark, sf_dir, "documents"), shards=16, seed=20240229)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, the numbers and the digest of the base spans, and all spans with those of high entropy; a null text has none."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, spans = F.col("secrets")["base"], F.col("secrets")["spans"]
    n = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(secrets.as_text(base), 256).alias("base_sha256"),
        secrets.as_text(spans).alias("spans"),
    )


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, class_id, class_size and whether it is the one kept; a text without words is a class of its own."""
    classes = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", "class_size", "kept")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query (vec_id divisible by 20) its 20 best other rows: query_id, rank, vec_id, score; unusable vectors take no part."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, measurements, base_failed, kept by the policy prod-1, and the ledger's bits; a null text has no words and fails."""
    ledger = quality.with_ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    m, bits = F.col("ledger")["m"], F.col("ledger")["bits"]
    return ledger.select(
        "doc_id",
        *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        (~quality.passes(bits, "base-1")).alias("base_failed"),
        quality.passes(bits, "prod-1").alias("kept"),
        bits.alias("fail_bits"),
    )


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, size, source_size, target of its source, and the words taken of it; a null source is a source of its own."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, expected_grade, tail_probability and kept; a text without words has zeros and is not kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = classifier.fit(docs, classifier.graded(table(spark, sf_dir, "labels")))
    rated = classifier.score(docs, model)
    return rated.select(
        "doc_id",
        F.col("rating.expected_grade").alias("expected_grade"),
        F.col("rating.tail_probability").alias("tail_probability"),
        (F.col("rating.tail_probability") >= classifier.TAIL).alias("kept"),
    )


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_html_extraction, op2_bpe_codec, op3_token_counts, op4_sharding, op5_secret_scans, op6_minhash_near_dedup,
            op7_exact_topk, op8_quality_rules, op9_source_mix, op10_quality_classifier,
        )
    }


def oracle_sql() -> dict:
    """Extraction, BPE, token counts by BPE, the Feistel shuffle, signatures and the fitted classifier are beyond SQL."""
    return oracles.all_sql()
