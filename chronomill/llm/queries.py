"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, chat, licenses, mixing, packing, periods, prefixes, quality, repair, simhash, sstable, tiff
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return chat.chat_digest(chat.format_chats(chat.text_messages(rows.unionByName(extra))))


def chat_typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations with an attachment in every message: placeholders, references and expanded token counts."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.parts_digest(chat.format_chats(chat.typed_messages(rows)))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "last_slot")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op5_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_media(table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.read_shards(sstable.write_shards(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2))


def op9_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the resampling keeps."""
    all_rows = quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return all_rows.where("kept").select("doc_id", "n_features", "score", "gumbel_key")


def op10_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.answers(prefixes.prefix_tables(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")))


def op11_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_digests(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repairs(repair.damaged(table(spark, sf_dir, "conversations")))


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file, which every machine has."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_chat_format,
        chat_typed_parts,
        op3_source_mix,
        op4_nearest_neighbours,
        op5_token_packing,
        op6_tiff_media,
        op7_simhash_near_dedup,
        op8_token_sstable,
        op9_quality_resampling,
        op10_prefix_token_counts,
        op11_pair_index_bpe,
        op12_periodic_runs,
        op13_conversation_repair,
    )
}
