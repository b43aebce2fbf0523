"""The queries of this subpackage: ``opN_<name>`` applies one operator to its whole table."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import decontaminate, hilbert, jaccard, merkle, packing, piece_codec, pseudonyms, quality, secrets, spelling, token_records, urls, warc
from panelwright.llm._store import new_dir
from panelwright.llm.sql import SQL


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: End of each document in the token files.
END_ID = 2


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    folder = token_records.fresh_folder(spark)
    manifest = token_records.write(docs, folder, tokenizer("byte_bpe_50k.json"), END_ID)
    return token_records.read_digests(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.fresh_ledger(spark))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


#: Setting of the session that holds the key of the pseudonyms, in hexadecimal digits.  Spark redacts settings with "secret".
KEY_SETTING = "spark.panelwright.pseudonyms.secretKey"
#: Key of the queries where the session has none.  Anybody can reverse its pseudonyms: it is for tests.
TEST_KEY = b"panelwright test key, not secret"


def pseudonym_key(spark: SparkSession) -> bytes:
    """The session's key; without one ``TEST_KEY``, with a warning, so that runs agree and can be linked."""
    given = spark.conf.get(KEY_SETTING, None) or spark.sparkContext.getConf().get(KEY_SETTING)
    if given:
        return bytes.fromhex(given)
    warnings.warn(f"{KEY_SETTING} is not set: pseudonyms of the public test key can be reversed by anybody", stacklevel=2)
    return TEST_KEY


def op8_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.apply(_read(spark, sf_dir, "documents").select("doc_id", "text"), pseudonym_key(spark))


def op9_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    book = quality.store(docs, new_dir(spark, "rule-ledger"))
    return quality.with_ablation(quality.apply_policy(book, "web-1"), "web-1").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(quality.mask("base-1")).cast("long")) != 0).alias("base_failed"),
        "kept",
        "fail_bits",
        "policy",
        "sole_rule",
        "n_sole",
    )


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(
        _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark").select("item_id", "text")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op2_url_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages").select("page_id", "url"))


def op3_bayes_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_warc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.read_digests(warc.write(pages, warc.fresh_folder(spark)))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return hilbert.shards(docs, 40)


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_codec.digests(docs, tokenizer("piece_bpe_32k.model"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_check(_read(spark, sf_dir, "documents").select(*merkle.FIELDS))


#: End of each document in the packed sequences, and their length.
PACK_END_ID, PACK_TOKENS = 1, 4096


def op12_exact_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.packed(docs, tokenizer("word_bpe_49k.json"), PACK_END_ID, PACK_TOKENS)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_winnowing, op2_url_automaton, op3_bayes_jaccard, op4_warc_shards, op5_hilbert_shards, op6_token_records, op7_blob_ledger, op8_feistel_pseudonyms, op9_rule_ledger, op10_piece_codec, op11_merkle_manifest, op12_exact_packing, op13_spelling_variants)}


def oracle_sql() -> dict:
    return dict(SQL)
