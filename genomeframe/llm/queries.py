"""The registered queries of the subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genomeframe.llm import (
    conversations,
    decontamination,
    digests,
    interpolation,
    licences,
    mixing,
    order_minhash,
    pieces,
    progressive,
    pseudonyms,
    spelling,
    token_files,
    toxicity,
)
from genomeframe.llm.common import documents, table
from genomeframe.session import shared_folder


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents by deleted interpolation."""
    return interpolation.score(documents(spark, sf_dir).select("doc_id", "text"))


def op2_progressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts stored as progressive images and read back, as digests."""
    stored = progressive.store_media(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    return progressive.media_digests(stored)


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms for validated numbers and dates: doc_id, text, n_replaced.

    The key is a parameter of the operator; this one is for the query only.
    """
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pseudonyms.pseudonymised(docs, b"query key", count="n_replaced")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of all documents and their decoded text, as digests."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pieces.encode_digests(docs, tokenizer("piece_bpe_32k.model"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document: doc_id, class_id."""
    return order_minhash.classes(documents(spark, sf_dir)).select("doc_id", "class_id")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: doc_id, size, source_size, target, taken, repetitions."""
    return mixing.mix_report(documents(spark, sf_dir))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best licence match of every document: doc_id, licence, dice, n_matches."""
    return licences.scan(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-ID files of all documents, read back: doc_id, start, n_tokens, ids_crc32."""
    folder = f"{shared_folder(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    path = tokenizer("byte_bpe_50k.json")
    shards = token_files.write_token_files(documents(spark, sf_dir), folder, path)
    return token_files.read_token_files(spark, shards, folder, path, digests=True)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents: doc_id, held_out, score, predicted."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        (toxicity.remainder(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.SCORE_LIMIT).cast("int").alias("predicted"),
    )


def op10_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents and of their edited texts, and their likeness."""
    return digests.edit_report(documents(spark, sf_dir))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents: word, n, n_near, form, form_n, root."""
    runs = spelling.letter_runs(documents(spark, sf_dir), spelling.SHORTEST)
    return spelling.variants(spelling.vocabulary(spelling.misspelt(runs)))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return decontamination.report(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired: conv_id, fault counts, cost, audit, repaired_sha256."""
    return conversations.report(conversations.damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_interpolation": op1_interpolation,
    "op2_progressive": op2_progressive,
    "op3_pseudonyms": op3_pseudonyms,
    "op4_pieces": op4_pieces,
    "op5_order_minhash": op5_order_minhash,
    "op6_mix": op6_mix,
    "op7_licences": op7_licences,
    "op8_token_files": op8_token_files,
    "op9_toxicity": op9_toxicity,
    "op10_digests": op10_digests,
    "op11_spelling": op11_spelling,
    "op12_decontamination": op12_decontamination,
    "op13_conversations": op13_conversations,
}

ORACLES: dict[str, str] = {
    "op6_mix": mixing.ORACLE,
    "op7_licences": licences.ORACLE,
    "op12_decontamination": decontamination.ORACLE,
}
