"""One query for each operator, over whole tables and with production parameters."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.llm.alignment import cross_alignment
from terrasift.llm.byte_bpe import bpe_encode, broadcast_tables
from terrasift.llm.common import fold, read_table, shared_dir
from terrasift.llm.content_store import read_digests, write_store
from terrasift.llm.conversation_repair import damaged, repair
from terrasift.llm.decontamination import find_leaks
from terrasift.llm.exact_dedup import exact_dedup
from terrasift.llm.language_id import language_id
from terrasift.llm.katz_lm import katz_scores
from terrasift.llm.license_scan import license_scan
from terrasift.llm.minhash_join import near_duplicates
from terrasift.llm.oracles import DECODED, EXACT_DEDUP, KATZ, LICENSE_PHRASES, NEAR_DUPLICATES, REPAIR
from terrasift.llm.token_files import token_counts
from terrasift.llm.toxicity import toxicity
from terrasift.llm.word_bpe import word_bpe_encode

#: Where the vocabulary files are; never copied into the repository.
TOKENIZERS = os.environ.get("TERRASIFT_TOKENIZERS", os.path.dirname(public_tokenizers.__file__))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"), keep="largest")


def tokenizer_file(name: str) -> str:
    with open(f"{TOKENIZERS}/{name}", encoding="utf-8") as file:
        return file.read()


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    end_id = 50256  # <|endoftext|>
    return token_counts(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id, shared_dir(spark))


def op3_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = language_id(docs, training=fold(docs["doc_id"], 4) != 2)
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", F.size("runs").alias("n_runs"))


def op4_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, name) for name in ("documents", "labels"))
    found = toxicity(docs, labels, training=lambda doc_id: fold(doc_id, 4) != 2)
    held_out = (fold(F.col("doc_id"), 4) == 2).alias("held_out")
    return found.select("doc_id", held_out, "score", "predicted", F.size("passages").alias("n_passages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    write_store(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), path := shared_dir(spark))
    return read_digests(spark, path)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = broadcast_tables(spark, f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken", public_tokenizers.PATTERN)
    coded = bpe_encode(read_table(spark, sf_dir, "documents"), tables, decode=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license_scan(read_table(spark, sf_dir, "documents")).drop("spans")
    return scanned.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op9_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = katz_scores(docs, training=fold(docs["doc_id"], 7) != 2)
    return scored.select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op11_cross_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(f"{TOKENIZERS}/piece_bpe_32k.model", "rb") as model:
        return cross_alignment(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), model.read())


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = damaged(read_table(spark, sf_dir, "conversations"))
    return repair(turns, turns["there"])


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = word_bpe_encode(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), ("packed", "decoded"))
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("packed") / 4).cast("long").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def bpe_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ids decode to, for a comparison with the texts."""
    return op7_byte_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the license scan that SQL can give."""
    return op8_license_scan(spark, sf_dir).drop("labels", "score")


def katz_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores under the backoff model, rounded as sums in another order differ in their last digits."""
    return op9_katz_backoff(spark, sf_dir).drop("held_out").withColumns({c: F.round(c, 4) for c in ("base_score", "score")})


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_crf_language_id": op3_crf_language_id,
    "op4_toxic_segments": op4_toxic_segments,
    "op5_content_store": op5_content_store,
    "op6_decontamination": op6_decontamination,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_license_scan": op8_license_scan,
    "op9_katz_backoff": op9_katz_backoff,
    "op10_minhash_join": op10_minhash_join,
    "op11_cross_alignment": op11_cross_alignment,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_word_bpe": op13_word_bpe,
    # results of operators above in the form that SQL gives too
    "bpe_decoded": bpe_decoded,
    "license_phrases": license_phrases,
    "katz_rounded": katz_rounded,
}
ORACLES = {
    "op1_exact_dedup": EXACT_DEDUP,
    "op10_minhash_join": NEAR_DUPLICATES,
    "op12_conversation_repair": REPAIR,
    "bpe_decoded": DECODED,
    "license_phrases": LICENSE_PHRASES,
    "katz_rounded": KATZ,
}
