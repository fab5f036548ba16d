"""The conversation model over the plain tables conversations(conv_id, turn, role, text) and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X

SOURCES = ("chatgpt", "codex", "gemini", "antigravity")
START, HOUR, MINUTE = 1_700_000_000.0, 3600.0, 60.0


def _source():
    return F.element_at(F.array(*map(F.lit, SOURCES)), (F.col("conv_id") % 4 + 1).cast("int"))


def _ids(df: DataFrame) -> DataFrame:
    df = df.withColumns({"source": _source(), "source_conversation_id": F.col("conv_id").cast("string")})
    df = df.withColumn("source_instance", F.when(F.col("source") == "gemini", "gemini-cli"))
    return df.withColumn("conversation_id", X.canonical_id(F.col("source"), F.col("source_instance"), F.col("source_conversation_id")))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = turns(spark, sf_dir).withColumn("turn_index", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long") - 1)
    return _ids(ranked).select(
        "conversation_id",
        F.concat_ws("-", F.lit("m"), "conv_id", "turn").alias("message_id"),
        "role",
        (F.lit(START) + HOUR * F.col("conv_id") + MINUTE * F.col("turn")).alias("create_time"),
        "turn_index",
        F.col("text").alias("normalized_text"),
    )


def transcript(ordered) -> F.Column:
    """`role: text` of each message that isn't blank, blank lines between; ordered: structs (turn, role, text)."""
    kept = F.filter(F.array_sort(ordered), lambda m: X.trimmed(m["text"]) != "")
    return F.array_join(F.transform(kept, lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n\n")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a conversation, from one aggregation of its turns."""
    grouped = turns(spark, sf_dir).groupBy("conv_id").agg(
        F.collect_list(F.struct("turn", "role", "text")).alias("turns"),
        F.count("*").alias("message_count"),
        F.count_if(F.col("role") == "user").alias("user_message_count"),
        F.count_if(F.col("role") == "assistant").alias("assistant_message_count"),
        F.max("turn").alias("last_turn"),
        F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("first_user"),
    )
    flags = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.col("toxic") == 1).select(F.col("doc_id").alias("conv_id"), F.lit(True).alias("flagged")).distinct()
    rows = _ids(grouped.join(flags, "conv_id", "left"))
    made = F.lit(START) + HOUR * F.col("conv_id")
    text = transcript(F.col("turns"))
    title = X.concise_title(F.col("first_user"))
    rows = rows.select(
        "conv_id",
        "conversation_id",
        "source",
        "source_instance",
        "source_conversation_id",
        F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(X.UNTITLED).alias("title"),
        made.alias("create_time"),
        F.when(F.col("conv_id") % 5 != 0, made + MINUTE * F.col("last_turn")).alias("update_time"),
        F.when(F.col("conv_id") % 7 != 0, F.concat(F.lit("model-"), F.col("conv_id") % 3)).alias("default_model_slug"),
        "message_count",
        "user_message_count",
        "assistant_message_count",
        text.alias("transcript_text"),
        F.array(F.concat(F.lit("t"), F.col("conv_id") % 2), F.concat(F.lit("u"), F.col("conv_id") % 3)).alias("topic_tags"),
        F.when(F.coalesce("flagged", F.lit(False)), F.array(F.lit("contains_pii"))).otherwise(F.array().cast("array<string>")).alias("risk_flags"),
    )
    return rows.withColumn("transcript_digest", X.digest(F.col("transcript_text")))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic queue: a summary job for each conversation not divisible by 3, an embedding job for each even."""
    base = _ids(turns(spark, sf_dir).select("conv_id").distinct())
    status = F.element_at(F.array(*map(F.lit, ("pending", "running", "complete", "failed"))), (F.col("conv_id") % 4 + 1).cast("int"))
    rows = base.select("conv_id", "conversation_id", F.explode(F.array(F.lit("summary"), F.lit("embedding"))).alias("kind"), status.alias("status"), (F.col("conv_id") % 3).alias("attempts"))
    kept = ((F.col("kind") == "summary") & (F.col("conv_id") % 3 != 0)) | ((F.col("kind") == "embedding") & (F.col("conv_id") % 2 == 0))
    return rows.where(kept).select(
        "conversation_id", "kind", "status", "attempts", F.lit(None).cast("string").alias("last_error"), F.timestamp_seconds(F.lit(int(START)) + 600 * F.col("conv_id")).alias("updated_at"), F.lit(None).cast("timestamp").alias("completed_at")
    )
