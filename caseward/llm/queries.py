"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseward.llm import bpe, cells, dialogues, language, lines, mixing, neighbours, quality, runs, simhash, substrings, token_files, warc
from caseward.sources.shared import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@register("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = language.learn(documents.filter(~held_out))
    found = language.predict(documents, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@register("op6_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op2_token_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(vocabulary("byte_bpe_50k.json"), encoding="utf-8") as file:
        definition = file.read()
    files = token_files.write_files(table(spark, sf_dir, "documents"), definition, new_path(spark, "token-ids"))
    return token_files.read_files(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@register("op3_line_dedup", lines.SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedupe(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_deleted", F.sha2("kept_text", 256).alias("kept_sha256"))


@register("op4_nearest_neighbours")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


@register("op5_simhash_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


@register("op7_bpe_encode_decode")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("word_bpe_49k.json")
    rows = bpe.encode(table(spark, sf_dir, "documents"), path, decode=True)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.judge(documents, quality.train(documents, table(spark, sf_dir, "labels")))


@register("op9_warc", warc.SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages"), new_path(spark, "warc")))


@register("op10_substring_dedup", substrings.SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedupe(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@register("op11_dialogue_repair", dialogues.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogues.hashed(dialogues.repair(dialogues.damaged(table(spark, sf_dir, "conversations"))))


@register("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(table(spark, sf_dir, "documents"))


@register("op13_embedding_near_dedup", cells.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.grouped(table(spark, sf_dir, "embeddings"))
