"""Registered queries: one for each operator, over whole tables, with the same names as the SQL in oracles."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.functions import vectors as V
from palimpsest.operators import fulltext, health, jobs, search, upsert
from palimpsest.operators.search import SearchOptions
from palimpsest.plans import adapter
from palimpsest.session import small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: A query text of which both search legs find something at every scale.
QUESTION = "thing from"
FIRST, LAST = 1_700_030_000.0, 1_700_300_000.0


def query(function):
    @wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return run


def listed(column: str | Column) -> Column:
    return F.array_join(column, ",")


def _brief(results: DataFrame, scored: bool = False) -> DataFrame:
    rows = results.select("conversation_id", "source", "title", "create_time", "update_time", "default_model_slug", listed("risk_flags").alias("risk_flags"), listed("topic_tags").alias("topic_tags"), "score")
    return rows.withColumn("score", F.round("score", 5)) if scored else rows.drop("score")


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, fulltext.FullTextIndex]:
    conversations = adapter.conversations(spark, sf_dir)
    return conversations, fulltext.FullTextIndex.build(conversations)


# --- metadata ----------------------------------------------------------------------------------------------------


@query
def metadata_search(spark, sf_dir):
    return _brief(search.metadata_search(adapter.conversations(spark, sf_dir), SearchOptions()))


@query
def metadata_search_filtered(spark, sf_dir):
    """The page is taken first, so fewer rows than the limit remain."""
    o = SearchOptions(sources=["chatgpt", "codex", "gemini"], model="model-1", topic_tags=["t1"], limit=40)
    return _brief(search.metadata_search(adapter.conversations(spark, sf_dir), o))


@query
def filter_all_tags(spark, sf_dir):
    rows = search.filtered(adapter.conversations(spark, sf_dir), SearchOptions(topic_tags=["t1", "u2"]))
    return rows.select("conversation_id", listed("topic_tags").alias("topic_tags"))


@query
def filter_risk_flags(spark, sf_dir):
    rows = search.filtered(adapter.conversations(spark, sf_dir), SearchOptions(risk_flags=["contains_pii"]))
    return rows.select("conversation_id", listed("risk_flags").alias("risk_flags"))


@query
def date_range(spark, sf_dir):
    rows = search.filtered(adapter.conversations(spark, sf_dir), SearchOptions(date_from=FIRST, date_to=LAST))
    return rows.select("conversation_id", search.effective_time().alias("effective_time"))


# --- conversations -----------------------------------------------------------------------------------------------


@query
def transcript(spark, sf_dir):
    return adapter.conversations(spark, sf_dir).select("conversation_id", F.sha2("transcript_text", 256).alias("transcript_sha256"), F.length("transcript_text").cast("long").alias("n_chars"))


@query
def digest_title(spark, sf_dir):
    return adapter.conversations(spark, sf_dir).select("conversation_id", "title", F.sha2("transcript_digest", 256).alias("digest_sha256"))


@query
def message_counts(spark, sf_dir):
    return adapter.conversations(spark, sf_dir).select("conversation_id", "message_count", "user_message_count", "assistant_message_count")


@query
def turn_index(spark, sf_dir):
    return adapter.messages(spark, sf_dir).select("conversation_id", "message_id", "turn_index")


@query
def canonical_id(spark, sf_dir):
    """Every case of the rule: instance null, empty and set."""
    doc = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    source = F.element_at(F.array(*map(F.lit, adapter.SOURCES)), (F.col("doc_id") % 4 + 1).cast("int"))
    instance = F.when(F.col("doc_id") % 3 == 0, F.lit("")).when(F.col("doc_id") % 3 == 1, F.lit("desk"))
    return doc.select("doc_id", X.canonical_id(source, instance, F.col("doc_id").cast("string")).alias("conversation_id"))


@query
def detail(spark, sf_dir):
    attachments = spark.createDataFrame([], "conversation_id string, attachment_id string, archive_path string, extension string, size_bytes long, source_ref string, linkage_json string")
    row = upsert.detail(adapter.conversations(spark, sf_dir), adapter.messages(spark, sf_dir), attachments, "codex:1")
    said = F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["turn_index"], m["message_id"], m["role"])), ",")
    return row.select("conversation_id", "title", "message_count", said.alias("messages"), F.coalesce(F.size("attachments"), F.lit(0)).alias("n_attachments"))


@query
def session_span(spark, sf_dir):
    """Least and greatest message time of a conversation."""
    return adapter.messages(spark, sf_dir).groupBy("conversation_id").agg(F.min("create_time").alias("create_time"), F.max("create_time").alias("update_time"))


@query
def first_user_message(spark, sf_dir):
    user = adapter.messages(spark, sf_dir).where(F.col("role") == "user")
    return user.groupBy("conversation_id").agg(F.min_by("message_id", "turn_index").alias("message_id"), X.concise_title(F.min_by("normalized_text", "turn_index")).alias("title"))


@query
def embedding_input(spark, sf_dir):
    rows = adapter.conversations(spark, sf_dir)
    summary = F.when(F.col("conv_id") % 2 == 0, F.struct(F.concat(F.lit("about "), "title").alias("abstract_text"), F.array(F.lit("k1"), F.lit("k2")).alias("key_points"), F.col("topic_tags").alias("candidate_topics")))
    return rows.select("conversation_id", F.sha2(X.embedding_input(F.col("title"), summary, F.col("transcript_digest")), 256).alias("input_sha256"))


# --- statistics --------------------------------------------------------------------------------------------------


@query
def stats_global(spark, sf_dir):
    archives = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"), F.col("url").alias("archive_path"))
    attachments = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return health.stats(adapter.conversations(spark, sf_dir), adapter.messages(spark, sf_dir), attachments, adapter.jobs(spark, sf_dir), archives)


@query
def count_by_source(spark, sf_dir):
    return health.count_by_source(adapter.conversations(spark, sf_dir))


@query
def source_health(spark, sf_dir):
    said = adapter.messages(spark, sf_dir).where(F.col("role") != "system")
    return health.source_health(adapter.conversations(spark, sf_dir), said)


@query
def job_progress(spark, sf_dir):
    return jobs.progress(adapter.jobs(spark, sf_dir))


# --- jobs and upserts --------------------------------------------------------------------------------------------


def _worked(spark, sf_dir) -> DataFrame:
    rows = adapter.conversations(spark, sf_dir)
    return rows.withColumn("summary_json", F.when(F.col("conv_id") % 4 == 1, F.lit('{"abstract_text":"x"}'))).withColumn("embedding", F.when(F.col("conv_id") % 8 == 1, F.array(F.lit(1.0))))


def _placed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("long"))


@query
def summary_targets(spark, sf_dir):
    return _placed(jobs.targets(_worked(spark, sf_dir), adapter.jobs(spark, sf_dir), "summary", limit=50))


@query
def summary_targets_forced(spark, sf_dir):
    return _placed(jobs.targets(_worked(spark, sf_dir), adapter.jobs(spark, sf_dir), "summary", force=True, limit=50))


@query
def embedding_targets(spark, sf_dir):
    return _placed(jobs.targets(_worked(spark, sf_dir), adapter.jobs(spark, sf_dir), "embedding", limit=50))


@query
def embedding_targets_forced(spark, sf_dir):
    return _placed(jobs.targets(_worked(spark, sf_dir), adapter.jobs(spark, sf_dir), "embedding", force=True, limit=50))


@query
def allow_list_semi(spark, sf_dir):
    """The allowed ids are kept before the limit."""
    allowed = adapter.conversations(spark, sf_dir).where(F.col("conv_id") % 6 == 0).select("conversation_id")
    return _placed(jobs.targets(_worked(spark, sf_dir), adapter.jobs(spark, sf_dir), "summary", ids=allowed, limit=10))


@query
def job_upsert(spark, sf_dir):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    every = adapter.conversations(spark, sf_dir)
    change = jobs.changes(every.where(F.col("conv_id") % 2 == 1), ["summary"], "complete", 1)
    merged = jobs.upsert(adapter.jobs(spark, sf_dir), change, now)
    return merged.select("conversation_id", "kind", "status", "attempts", F.unix_seconds("updated_at").alias("updated_at"), F.unix_seconds("completed_at").cast("string").alias("completed_at"))


@query
def stale_jobs(spark, sf_dir):
    now = F.lit("2023-11-15 06:00:00").cast("timestamp")
    reset = jobs.reset_stale(adapter.jobs(spark, sf_dir), 20, now)
    return reset.select("conversation_id", "kind", "status", F.unix_seconds("updated_at").alias("updated_at"))


def _incoming(spark, sf_dir) -> DataFrame:
    """Every third conversation again, every sixth with another title, and as many new ones."""
    rows = adapter.conversations(spark, sf_dir).where(F.col("conv_id") % 3 == 0)
    again = rows.withColumn("title", F.when(F.col("conv_id") % 6 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    new = rows.withColumn("conversation_id", F.concat(F.lit("new:"), "conversation_id"))
    return again.unionByName(new).select("conversation_id", "title", "transcript_text", "update_time")


@query
def upsert_changed(spark, sf_dir):
    """Change detection and invalidation: derived columns of changed conversations go, review columns stay."""
    existing = _worked(spark, sf_dir).select("conversation_id", "title", "transcript_text", "update_time", "summary_json", "topic_tags", F.lit("seen").alias("review_status"))
    merged = upsert.upsert(existing, _incoming(spark, sf_dir))
    return merged.select("conversation_id", "title", "update_time", "summary_json", listed("topic_tags").alias("topic_tags"), "review_status")


@query
def change_detection(spark, sf_dir):
    return upsert.changed(adapter.conversations(spark, sf_dir), _incoming(spark, sf_dir))


@query
def replace_children(spark, sf_dir):
    old = adapter.messages(spark, sf_dir).select("conversation_id", "message_id", "normalized_text")
    parents = adapter.conversations(spark, sf_dir).where(F.col("conv_id") % 3 == 0).select("conversation_id")
    new = old.join(parents, "conversation_id", "left_semi").where(F.col("message_id").endswith("0")).withColumn("normalized_text", F.lit("again"))
    return upsert.replace_children(old, new, parents).select("conversation_id", "message_id", F.sha2("normalized_text", 256).alias("text_sha256"))


@query
def skip_existing_anti(spark, sf_dir):
    """Rows with unknown ids, or none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("doc_id")).alias("key"))
    known = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("key"))
    return upsert.skip_existing(docs, known, "key").select("doc_id")


@query
def asset_links(spark, sf_dir):
    """Attachments: file tokens of texts against those in member names."""
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    said = F.concat(F.lit("see file_"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit("-a and file_x"), F.col("doc_id") % 10, F.lit("."))
    tokens = ids.select(F.col("doc_id").cast("string").alias("conversation_id"), F.explode(X.file_tokens(said)).alias("token"))
    paths = ids.where(F.col("doc_id") % 7 == 0).select(F.concat(F.lit("dir/file_"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit("-a/audio.wav")).alias("path"))
    return upsert.attachment_rows(tokens, paths).select("conversation_id", "attachment_id", "archive_path", "extension", "source_ref")


# --- text functions ----------------------------------------------------------------------------------------------


@query
def file_tokens(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    said = F.concat(F.col("text"), F.lit(" file_"), F.col("doc_id"), F.lit("_z, file_b-"), F.col("source"), F.lit(" file_"))
    return docs.select("doc_id", listed(X.file_tokens(said)).alias("tokens"))


@query
def dedupe_join(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.sha2(X.dedupe_join(F.split("text", "\n")), 256).alias("joined_sha256"))


@query
def epoch_normalise(spark, sf_dir):
    """Seconds from numbers of seconds or milliseconds, and from RFC 3339 strings."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stamp = F.col("ts").cast("timestamp")
    millis = F.unix_millis(stamp)
    number = F.when(F.col("event_id") % 2 == 0, millis.cast("double")).otherwise(millis / 1000.0)
    said = F.when(F.col("event_id") % 3 == 0, F.lit("not a time")).otherwise(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return events.select("event_id", F.round(X.epoch_seconds(number), 3).alias("seconds"), F.round(X.rfc3339_seconds(said), 3).alias("stamp_seconds"))


@query
def json_props(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# --- full text ---------------------------------------------------------------------------------------------------


def _found(spark, sf_dir, text: str) -> DataFrame:
    _, index = _index(spark, sf_dir)
    return fulltext.matches(index, text).select("conversation_id", F.round("score", 6).alias("score"))


@query
def fts_tokens(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokens = X.tokens(F.col("text"))
    return docs.select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.sha2(F.array_join(tokens, " "), 256).alias("tokens_sha256"))


@query
def fts_document_frequency(spark, sf_dir):
    _, index = _index(spark, sf_dir)
    return fulltext.document_frequencies(index.postings)


@query
def fts_and(spark, sf_dir):
    return _found(spark, sf_dir, "thing from")


@query
def fts_or(spark, sf_dir):
    return _found(spark, sf_dir, "thing OR tion")


@query
def fts_not(spark, sf_dir):
    return _found(spark, sf_dir, "tion NOT thing")


@query
def fts_phrase(spark, sf_dir):
    return _found(spark, sf_dir, '"of the"')


@query
def fts_prefix(spark, sf_dir):
    return _found(spark, sf_dir, "thin*")


@query
def fts_column(spark, sf_dir):
    return _found(spark, sf_dir, "title : the")


@query
def fts_initial(spark, sf_dir):
    return _found(spark, sf_dir, "^user")


@query
def fts_near(spark, sf_dir):
    return _found(spark, sf_dir, "NEAR(thing from, 12)")


@query
def fts_search(spark, sf_dir):
    """The page of a full-text search, with snippets."""
    conversations, index = _index(spark, sf_dir)
    return search.fts_search(conversations, index, SearchOptions(query=QUESTION)).select("conversation_id", F.round("score", 6).alias("score"), "snippet")


# --- vectors and fusion ------------------------------------------------------------------------------------------


def _vectors(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    none = [F.lit(None).cast("string").alias(c) for c in ("source", "source_instance", "source_conversation_id", "title", "default_model_slug")]
    tags = [F.array().cast("array<string>").alias(c) for c in ("risk_flags", "topic_tags")]
    return e.select(F.col("vec_id").cast("string").alias("conversation_id"), "embedding", F.lit(0.0).alias("create_time"), F.lit(0.0).alias("update_time"), *none, *tags)


@query
def cosine_knn(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    vector = list(rows.where(F.col("conversation_id") == "0").select("embedding").first()[0])
    return search.semantic_search(rows, vector, SearchOptions()).select("conversation_id", F.round("score", 6).alias("score"))


@query
def related(spark, sf_dir):
    return search.related(_vectors(spark, sf_dir), "7").select("conversation_id", F.round("score", 6).alias("score"))


@query
def hashed_embedding(spark, sf_dir):
    """Signed weights by bucket, before normalisation."""
    rows = adapter.conversations(spark, sf_dir).select("conversation_id", F.posexplode(V.hashed_sums_col(F.col("transcript_text"))).alias("bucket", "weight"))
    return rows.where(F.col("weight") != 0).select("conversation_id", F.col("bucket").cast("long").alias("bucket"), F.col("weight").cast("double").alias("weight"))


def _embedded(spark, sf_dir) -> DataFrame:
    return adapter.conversations(spark, sf_dir).withColumn("embedding", V.hashed_embedding_col(F.col("transcript_text")))


@query
def semantic_search(spark, sf_dir):
    vector = V.hashed_embedding(QUESTION).tolist()
    found = search.semantic_search(_embedded(spark, sf_dir), vector, SearchOptions(sources=["chatgpt", "codex"]))
    return found.select("conversation_id", F.round("score", 5).alias("score"))


@query
def rank_fusion(spark, sf_dir):
    """Fusion alone: a list by length and a list by time."""
    rows = adapter.conversations(spark, sf_dir).select("conversation_id", F.length("transcript_text").alias("n"), "create_time")
    a = search.ranked(rows.orderBy(F.desc("n"), "conversation_id").limit(40), F.desc("n"), "conversation_id").select("conversation_id", "rank0")
    b = search.ranked(rows.orderBy("create_time").limit(40), "create_time").select("conversation_id", "rank0")
    return search.fused([a, b], 25).select("conversation_id", F.round("score", 8).alias("score"))


@query
def hybrid_rrf(spark, sf_dir):
    conversations = _embedded(spark, sf_dir)
    index = fulltext.FullTextIndex.build(conversations)
    vector = V.hashed_embedding(QUESTION).tolist()
    found = search.hybrid_search(conversations, index, vector, SearchOptions(query=QUESTION), snippets=False)
    return found.select("conversation_id", "title", F.round("score", 8).alias("score"))
