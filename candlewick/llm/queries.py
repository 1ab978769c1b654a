"""The operators' registered queries, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, langid, licenses, packing, repeats, secrets, simhash, warc, whitening, winnow
from .common import Scratch, read_table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", F.char_length("value").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op3_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.bfd_pack(read_table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select(
        "sequence_id", F.element_at("cu_seqlens", -1).cast("long").alias("n_tokens"), F.crc32("input_ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32"), "cu_seqlens", "doc_ids", "starts", "doc_tokens"
    )


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.harmonic_pack(read_table(spark, sf_dir, "documents"), tokenizer_path()))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(read_table(spark, sf_dir, "documents"), Scratch(spark, "repeats"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "warc").path()
    manifest = warc.write_warc(read_table(spark, sf_dir, "pages"), path)
    return warc.read_warc(manifest, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(read_table(spark, sf_dir, "documents"), Scratch(spark, "simhash"))
    return groups.select("doc_id", simhash.hex_print("fingerprint").alias("fingerprint"), "component_id")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = winnow.edited(read_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_chars", "edited_sha256", winnow.digest(F.col("fingerprint")).alias("fingerprint"), winnow.digest(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(read_table(spark, sf_dir, "embeddings"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"), Scratch(spark, "divergence"))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("<|im_end|><|im_start|>assistant ok").alias("text"))
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.chat_digests(turns, tokenizer_path(), Scratch(spark, "chat"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from corpus_pipeline import run

    return {f.__name__: f for f in (op1_secrets, op2_licenses, op3_token_matrices, op4_harmonic_packing, op5_repeats, op6_warc, op7_decontamination, op8_simhash, op9_language, op10_winnowing, op11_whitening, op12_divergence, op13_chat)} | {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"op2_licenses": licenses.sql(), "op6_warc": warc.SQL, "op12_divergence": divergence.SQL, "op7_decontamination": decontaminate.SQL.format(docs="documents", n=5, threshold=0.8)}
