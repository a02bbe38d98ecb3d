"""Queries of the operators over their whole tables, and their SQL.

The SQL is in ``sql``; operators that SQL can't express have none and are tested against
brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe, divergence, fixity, language, manifest, mixing, ngram_join, piece_bpe, prefix_hash, secrets, sql, substring, toxicity
from .common import documents


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents by 3-word shingles at a Jaccard similarity of 0.9."""
    return ngram_join.ngram_join(documents(spark, sf_dir).select("doc_id", "text"), k=3, num=90, den=100)


def vocabulary() -> str:
    """Place of the vocabulary file; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _fold(k: int):
    """The remainder by ``k`` that decides what is held out; a null id counts as blank."""
    return F.expr(f"crc32(coalesce(cast(doc_id AS string), '')) % {k}")


def op1_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of all vectors, and where clips of every fiftieth of them are found."""
    return audio.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def replica(pages: DataFrame) -> DataFrame:
    """A replica of the archive with planted damage, the same in every run: of 64 records
    one has its last byte changed, one is lost, and one is added."""
    damage = F.pmod(F.col("page_id") * 37, F.lit(64))
    record = F.when(damage == 0, F.concat(F.expr("left(record, length(record) - 1)"), F.lit("?"))).otherwise(F.col("record"))
    kept = pages.filter(damage != 1).select("record_id", record.alias("record"))
    added = pages.filter(damage == 2).select((-F.col("record_id") - 1).alias("record_id"), "record")
    return kept.unionByName(added)


def op3_warc_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the page archive in which a damaged replica differs."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages = pages.select("page_id", F.col("page_id").alias("record_id"), fixity.warc_record(F.col("url"), F.col("html")).alias("record"))
    return fixity.audit(pages.select("record_id", "record"), replica(pages))


def op4_prefix_hash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edit, and their likeness."""
    return prefix_hash.fingerprints(documents(spark, sf_dir))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, with parts linked within scopes."""
    return secrets.spans(documents(spark, sf_dir))


def op5_toxicity_by_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; the fifth fold is held out of learning."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(_fold(5) != 0)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_language_by_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; the fold with remainder 1 is held out of learning."""
    docs = documents(spark, sf_dir)
    model = language.fit(docs.filter(_fold(3) != 1))
    found = language.classify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (_fold(3) == 1).alias("held_out"), "lang_pred", "score", "accepted")


def op6_byte_pair_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text and what they decode to, as digests."""
    return bpe.round_trip(documents(spark, sf_dir), vocabulary())


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of smaller documents."""
    return substring.remove_repeats(documents(spark, sf_dir))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents to source targets takes of each."""
    return mixing.taken(documents(spark, sf_dir)).drop("source")


def piece_model() -> str:
    """Place of the SentencePiece model file; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_sentence_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every text, what they decode to, and whether the library agrees."""
    return piece_bpe.round_trip(documents(spark, sf_dir), piece_model())


#: Columns of a document in the order in which the manifest hashes them.
HASHED = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document held against the root of all, with a fifth of them tampered with."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return manifest.audit(documents(spark, sf_dir), HASHED, {"text": lower}, tampered)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language differ, and the terms that tell them apart."""
    return divergence.audit(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op")}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
