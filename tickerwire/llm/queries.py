"""One query per operator, over its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerwire.llm import (chat, content_sort, conversation_repair, decontaminate, fill_in_middle, minhash, packing, pii,
                            quality, suffixes, toxicity, url_filters, warc)
from tickerwire.llm.common import cut, text_key

# Rules of the URL query: (host, path, verdict).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "judged.*")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")],
                                  "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat.parse_chat(chat.format_chat(turns.withColumn("parts", chat.text_parts(F.col("text")))))
    loss = F.array_join("turns.loss", "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = minhash.classes(docs).select("key", "class_id", "n_docs")
    return docs.select("doc_id", text_key(F.col("text")).alias("key")).join(found, "key").select("doc_id", "class_id", "n_docs")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return decontaminate.find(docs.select("doc_id", "text"), items).select(
        "doc_id", "item_id", F.col("begin").cast("long").alias("begin"), "similarity")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    index = warc.write(_table(spark, sf_dir, "pages"), folder)
    return warc.read(index, folder, bodies=False).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.sanitise(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.array_join(F.flatten(F.array(*[pii.span_list(k, F.col(f"found.{k}")) for k in pii.KINDS])), ",")
    terms = F.array_join(pii.span_list("term", F.col("terms")), ",")
    return done.select("row.doc_id", *[F.size(f"found.{k}").cast("long").alias(f"n_{k}") for k in pii.KINDS],
                       F.sha2(base, 256).alias("base_sha256"),
                       F.concat_ws(",", F.nullif(base, F.lit("")), F.nullif(terms, F.lit(""))).alias("spans"))


def categories() -> dict[str, Column]:
    """The chain over the labels table: a low-quality text first, its
    probability being an input of the toxicity model."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    models = toxicity.train(docs, _table(spark, sf_dir, "labels"), categories())
    return toxicity.score(docs, models).select(
        "row.doc_id", F.round(F.col("p")[0], 6).alias("p_low_quality"), F.round(F.col("p")[1], 6).alias("p_toxic"),
        (F.col("p")[1] >= toxicity.THRESHOLD).alias("toxic"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.judge(docs, carry=["doc_id"]).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.mark(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep="greatest").select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with the faults of the repair query, by crc32 of
    ``conv_id:turn`` modulo 20: 0 gone, 1 empty, 2 without ends of sentences,
    3 twice, 4 said by the user. Nulls are one blank."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    said = F.when(lot == 1, "").when(lot == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    return rows.select("conv_id", "turn", F.when(lot == 4, "user").otherwise(text("role")).alias("role"), said.alias("text"),
                       (lot == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(lot == 3, 2).otherwise(1))).alias("copy"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_digests(damaged(_table(spark, sf_dir, "conversations")), gone=F.col("gone"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = cut(fill_in_middle.store(_table(spark, sf_dir, "documents")), "fim-frames")
    return fill_in_middle.digests(fill_in_middle.transform(stored)).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_url_filters, op2_chat_format, op3_dart_minhash, op4_decontamination, op5_warc, op6_pii, op7_toxicity,
        op8_suffix_dedup, op9_quality_rules, op10_packing, op11_exact_dedup, op12_conversation_repair, op13_fill_in_middle)}
