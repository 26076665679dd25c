"""The registered queries of this subpackage: one ``opN_<name>`` each, and ``pipeline``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanweave.llm import bpe, chat, decontaminate, infill, licenses, lines, quality, simhash, suffixes, tiff, token_counts, toxicity, variants
from scanweave.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines, how many went as boilerplate, and a digest of the text that stays."""
    out = lines.line_dedup(table(spark, sf_dir, "documents"))
    kept = F.sha2(F.coalesce("text", F.lit("")), 256)
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), kept.alias("kept_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of each document."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, bpe.pieces(spark, path))


def op3_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and features of each document's bytes, stored as TIFF and read back."""
    return tiff.payload_digests(tiff.stored(table(spark, sf_dir, "documents")))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint and the least doc_id of its group of near duplicates."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of documents and benchmark items that overlap."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's toxicity score; every fourth document by the CRC-32 of its id is held out from learning."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.fit(docs, table(spark, sf_dir, "labels"), held_out=2).score(docs)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each conversation's turns and of its text under the loss mask, read back from the training text."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    one = F.to_json(F.struct(said.alias("prompt"), said.alias("completion")))
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), one.alias("record"))
    records = chat.turn_records(own).unionByName(extra)
    turns = chat.canonical_turns(records, ("conv_id", "turn"))
    return chat.conversation_digests(chat.formatted(turns))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's bytes that a 200-byte string covers which occurs elsewhere, and a digest of the others."""
    out = suffixes.suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence notices of each document."""
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op7_quality_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in the quality sample, with their log weight and Gumbel key."""
    out = quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_ngrams", "log_weight", "gumbel_key")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's bytes and tokens, and whether these exceed 4096."""
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines with the middle ones moved to the end, and digests of that and of the text rebuilt from it."""
    return infill.digests(infill.transformed(table(spark, sf_dir, "documents")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the documents, misspellings planted among them, with their near words and the form they are variants of."""
    occurring = variants.thinned(variants.occurrences(table(spark, sf_dir, "documents")))
    return variants.spelling_variants(variants.counts(occurring))


def queries() -> dict[str, Query]:
    own = [
        op1_line_dedup, op2_bpe, op3_tiff_media, op4_simhash_near_dedup, op5_decontaminate, op6_suffix_dedup,
        op7_quality_resample, op8_toxicity, op9_chat_format, op10_license_scan, op11_token_counts, op12_infill,
        op13_spelling_variants,
    ]
    import corpus_pipeline

    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": lines.ORACLE, "op5_decontaminate": decontaminate.ORACLE, "op9_chat_format": chat.ORACLE,
        "op12_infill": infill.ORACLE, "op13_spelling_variants": variants.ORACLE,
    }
