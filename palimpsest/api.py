"""The index as a library, with the tool names and access tiers of its server."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from enum import StrEnum
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest import schema
from palimpsest.functions import text as X
from palimpsest.functions import vectors as V
from palimpsest.operators import fulltext, health, jobs, upsert
from palimpsest.operators import search as searching
from palimpsest.schema import JobKind, JobStatus
from palimpsest.session import small_batches
from palimpsest.sources import backup as copies
from palimpsest.sources import exports, normalized, providers
from palimpsest.sources.store import Store, delete, exists
from palimpsest.streaming import sync as syncing

DIRECT_BYTES, CHUNK_BYTES = 16_000, 12_000
IMPORT_CAP = 100


def extractive_summary(transcript: str) -> dict:
    """The summariser used where no other is given: the first lines of a transcript, deterministically."""
    lines = [x.strip() for x in transcript.split("\n") if x.strip()]
    return {"abstract_text": " ".join(" ".join(lines[:3]).split()[:90]), "key_points": lines[:3], "candidate_topics": [], "entities": [], "risk_flags": [], "site_usefulness": "Not judged.", "redaction_notes": []}


def summarise(transcript: str, summariser: Callable[[str], dict]) -> dict:
    """Short transcripts at once, long ones by chunks and then over the chunks' abstracts; what fails is tried again with
    the condensed transcript. Flags outside the vocabulary are dropped."""
    try:
        if len(transcript.encode()) <= DIRECT_BYTES:
            out = summariser(transcript)
        else:
            parts = [summariser(x)["abstract_text"] for x in X.chunks(transcript, CHUNK_BYTES)]
            out = summariser(X.input_window("\n".join(parts), DIRECT_BYTES))
    except Exception:  # whatever a summariser raises, the condensed form is the second try
        out = summariser(X.condense(transcript))
    out = {f.name: out[f.name] for f in schema.SUMMARY}
    return out | {"risk_flags": [x for x in out["risk_flags"] if x in schema.RISK_FLAGS]}


class Index:
    """An index in a folder. Searches are lazy; writes commit one snapshot each."""

    def __init__(self, spark: SparkSession, home: str, summariser: Callable[[str], dict] = extractive_summary, buckets: int = 16):
        small_batches(spark)
        self.spark, self.store, self.summariser = spark, Store(spark, home, buckets), summariser

    def table(self, name: str) -> DataFrame:
        return self.store.table(name)

    # --- writing -------------------------------------------------------------------------------------------------

    def _next_id(self, name: str) -> int:
        return (self.table(name).agg(F.max("id")).first()[0] or 0) + 1

    def _ledger(self, name: str, rows: list[dict]) -> DataFrame:
        kind = schema.TABLES[name]
        new = self.spark.createDataFrame([tuple(row.get(c) for c in kind.names) for row in rows], kind)
        stamp = {"archives": "imported_at", "runs": "started_at"}[name]
        return self.table(name).unionByName(new.withColumn(stamp, F.current_timestamp()))

    def _write(self, incoming: DataFrame, messages: DataFrame, attachments: DataFrame, label: str, kind: str, archives: list[dict]) -> dict:
        """Conversations, children and jobs of the touched buckets, and the ledgers, in one snapshot."""
        clashing = upsert.colliding(messages).persist()
        errors = [f"{r[0]}: repeated message id" for r in clashing.orderBy("conversation_id").limit(1000).collect()]
        keep = lambda df: df.join(clashing, "conversation_id", "left_anti")
        incoming = keep(incoming).persist()
        messages, attachments = keep(messages), keep(attachments)
        buckets = self.store.touched(incoming)
        part = lambda name: self.store.part(name, buckets)
        fresh = upsert.changed(part("conversations"), incoming).where("changed").select("conversation_id")
        parents = incoming.select("conversation_id")
        n, m = incoming.count(), messages.count()
        report = {"archive_path": label, "conversations_indexed": n, "messages_indexed": m, "errors": errors, "errors_total": clashing.count()}
        run = {"id": self._next_id("runs"), "run_kind": kind, "archive_path": label, "status": "failed" if errors else "complete", "counters_json": json.dumps(report), "notes_json": json.dumps({"error": errors[0]} if errors else {})}
        changes = {
            "conversations": upsert.upsert(part("conversations"), incoming),
            "messages": upsert.replace_children(part("messages"), messages, parents),
            "attachments": upsert.replace_children(part("attachments"), attachments, parents),
            "jobs": jobs.upsert(part("jobs"), jobs.enqueue(fresh)),
        }
        ledgers = {"archives": self._ledger("archives", archives), "runs": self._ledger("runs", [run]).withColumn("completed_at", F.coalesce("completed_at", F.when(F.col("id") == run["id"], F.current_timestamp())))}
        self.store.commit((changes if buckets else {}) | ledgers, buckets)
        incoming.unpersist()
        clashing.unpersist()
        return report

    def import_normalized(self, rows: DataFrame, label: str = "normalized-input", reindex: bool = True) -> dict:
        self.store.begin()
        archive = {"id": self._next_id("archives"), "archive_path": label, "source_path": label, "import_mode": "normalized"}
        last = upsert.last_of(rows).persist()
        incoming = upsert.conversation_rows(last, archive["id"])
        # a digest of the batch that is free of order and takes one row: sums of hashes of ids with update times
        fact = F.sha2(F.concat_ws(":", "conversation_id", F.coalesce("update_time", F.lit(0.0))), 256)
        part = lambda at: F.coalesce(F.sum(F.conv(F.substring(fact, at, 15), 16, 10).cast("decimal(38,0)")), F.lit(0))
        facts = incoming.agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", F.count("*"), *map(part, (1, 16, 31, 46))), 256).alias("sha")).first()
        archive |= {"sha256_hex": facts["sha"], "size_bytes": facts["n"]}
        report = self._write(incoming, upsert.message_rows(last), self.spark.createDataFrame([], schema.ATTACHMENTS), label, "normalized_import", [archive])
        last.unpersist()
        if reindex:
            self.reindex()
        return report

    def import_archive(self, path: str, run_jobs: bool = False, force: bool = False, mode: str | None = None) -> dict:
        """An account export: conversations, messages, attachments; then, if wanted, summaries and embeddings. With a mode
        (copy or adopt) the archive is first staged in the index's folder. Of a conversation that the archive repeats, the
        last copy counts, with its messages and attachments."""
        if mode is not None:
            path = exports.stage(self.spark, path, self.store.home, schema.ImportMode(mode))
        self.store.begin()
        first = self._next_id("archives")
        unpacked = exports.unpack(self.spark, path, f"{self.store.home}/unpacked-{uuid4().hex}")
        try:
            archives = [{"id": first + i, "archive_path": at, "source_path": at, "sha256_hex": sha, "size_bytes": size, "import_mode": mode or "in_place"} for i, (at, sha, size) in enumerate(unpacked.archives)]
            last = upsert.last_of(exports.read(unpacked), F.col("position")).persist()
            incoming = upsert.conversation_rows(last, F.col("archive_number") + first)
            own = ("archive_number", "archive_member")
            tokens = last.select(*own, F.col("source_conversation_id").alias("conversation_id"), F.explode("tokens").alias("token"))
            attachments = upsert.attachment_rows(tokens, exports.members(unpacked), own)
            report = self._write(incoming, upsert.message_rows(last), attachments, path, "import", archives)
            last.unpersist()
        finally:
            delete(self.spark, unpacked.folder)
        self.reindex()
        if run_jobs:
            report |= {"summaries_completed": self.rebuild_summaries(force), "embeddings_completed": self.rebuild_embeddings(force)}
            self.reindex()
        return report

    def sync(self, provider: str, roots: list[str], **options) -> dict:
        return syncing.sync(self, provider, roots, **options)

    def import_provider(self, provider: str, roots: list[str], since: str | None = None, skip_existing: bool = False) -> dict:
        """One shot: no time filter on files, parse errors reported, no cursor."""
        return syncing.import_files(self, provider, roots, None if since is None else syncing.parse_since(since), skip_existing=skip_existing)

    def export_provider(self, provider: str, roots: list[str], since: str | None = None) -> DataFrame:
        """Normalized conversations of local files, without writing the index. Parse errors are errors."""
        rows = providers.read(self.spark, provider, roots, None if since is None else syncing.parse_since(since))
        return rows.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")))).where(F.col("conversation").isNotNull()).select("conversation.*")

    # --- derived columns -----------------------------------------------------------------------------------------

    def _jobs_done(self, table: DataFrame, ids: DataFrame, kind: JobKind, good: DataFrame, bad: DataFrame) -> DataFrame:
        """Both state changes of a pass: running with one attempt more, then complete or failed."""
        table = jobs.upsert(table, jobs.changes(ids, [kind], JobStatus.RUNNING, 1))
        ended = jobs.changes(good, [kind], JobStatus.COMPLETE).unionByName(jobs.changes(bad, [kind], JobStatus.FAILED, error=F.col("error")))
        return jobs.upsert(table, ended)

    def _chosen(self, kind: JobKind, force: bool, ids: list[str] | None, limit: int | None) -> tuple[DataFrame, list[int]]:
        """A pass's targets, and the buckets that hold them: no others are read again or written."""
        self.store.begin()
        chosen = jobs.targets(self.table("conversations"), self.table("jobs"), kind, force, ids, limit).persist()
        return chosen, self.store.touched(chosen)

    def rebuild_summaries(self, force: bool = False, ids: list[str] | None = None, limit: int | None = None) -> int:
        chosen, buckets = self._chosen(JobKind.SUMMARY, force, ids, limit)
        if not buckets:
            return 0
        rows = self.store.part("conversations", buckets)
        texts = rows.join(chosen, "conversation_id", "left_semi").select("conversation_id", "transcript_text")
        call = self.summariser

        def run(batches):
            import pandas as pd

            for batch in batches:
                rows = []
                for own_id, text in zip(batch["conversation_id"], batch["transcript_text"], strict=True):
                    try:
                        rows.append((own_id, summarise(text or "", call), None))
                    except Exception as error:  # a summariser's failure is that job's result
                        rows.append((own_id, None, f"{type(error).__name__}: {error}"))
                yield pd.DataFrame(rows, columns=["conversation_id", "summary", "error"])

        kind = T.StructType([T.StructField("conversation_id", T.StringType()), T.StructField("summary", schema.SUMMARY), T.StructField("error", T.StringType())])
        made = texts.mapInPandas(run, kind).persist()
        good, bad = made.where(F.col("error").isNull()), made.where(F.col("error").isNotNull())
        done = good.count()
        queue = self._jobs_done(self.store.part("jobs", buckets), made.select("conversation_id"), JobKind.SUMMARY, good, bad)
        self.store.commit({"conversations": upsert.write_summaries(rows, good, "extractive-v1"), "jobs": queue}, buckets)
        made.unpersist()
        chosen.unpersist()
        return done

    def embedding_inputs(self, ids: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
        rows = (self.table("conversations") if conversations is None else conversations).join(ids, "conversation_id", "left_semi")
        summary = F.from_json("summary_json", schema.SUMMARY, {"mode": "FAILFAST"})
        return rows.select("conversation_id", X.embedding_input(F.col("title"), summary, F.col("transcript_digest")).alias("input"))

    def rebuild_embeddings(self, force: bool = False, ids: list[str] | None = None, limit: int | None = None) -> int:
        chosen, buckets = self._chosen(JobKind.EMBEDDING, force, ids, limit)
        if not buckets:
            return 0
        rows = self.store.part("conversations", buckets)
        made = self.embedding_inputs(chosen, rows).select("conversation_id", V.hashed_embedding_col(F.col("input")).alias("vector")).persist()
        done = made.count()
        none = made.where(F.lit(False)).select("conversation_id", F.lit("").alias("error"))
        queue = self._jobs_done(self.store.part("jobs", buckets), made.select("conversation_id"), JobKind.EMBEDDING, made, none)
        self.store.commit({"conversations": upsert.write_embeddings(rows, made, V.MODEL), "jobs": queue}, buckets)
        made.unpersist()
        chosen.unpersist()
        return done

    def resume(self) -> dict:
        out = {"summaries_completed": self.rebuild_summaries(), "embeddings_completed": self.rebuild_embeddings()}
        self.reindex()
        return out

    def reset_stale_jobs(self, minutes: int = jobs.STALE_MINUTES, now: Column | None = None) -> None:
        self.store.begin()
        self.store.commit({"jobs": jobs.reset_stale(self.table("jobs"), minutes, now)})

    # --- reading -------------------------------------------------------------------------------------------------

    def _fts_path(self) -> str:
        return f"{self.store.home}/fts"

    def reindex(self) -> None:
        """Build the full-text index of the current snapshot; searches use it until the next build."""
        fulltext.FullTextIndex.build(self.table("conversations")).write(self._fts_path(), self.store.manifest()["buckets"])

    def _fts(self) -> fulltext.FullTextIndex:
        if not exists(self.spark, f"{self._fts_path()}/lengths"):
            self.reindex()
        return fulltext.FullTextIndex.read(self.spark, self._fts_path())

    def search(self, options: searching.SearchOptions | None = None, **kwargs) -> DataFrame:
        options = options or searching.SearchOptions(**kwargs)
        needs = options.query is not None and options.mode not in (schema.SearchMode.METADATA, schema.SearchMode.SEMANTIC)
        return searching.search(self.table("conversations"), self._fts() if needs else None, options)

    def related(self, conversation_id: str, limit: int = searching.RELATED_LIMIT) -> DataFrame:
        return searching.related(self.table("conversations"), conversation_id, limit)

    def get_conversation(self, conversation_id: str, include_raw: bool = False) -> DataFrame:
        return upsert.detail(self.table("conversations"), self.table("messages"), self.table("attachments"), conversation_id, include_raw)

    def source_conversation_ids(self, source: str) -> DataFrame:
        return self.table("conversations").where(F.col("source") == source).select("source_conversation_id").distinct()

    def stats(self) -> dict:
        one = health.stats(*(self.table(t) for t in ("conversations", "messages", "attachments", "jobs", "archives"))).first().asDict()
        return one | {"conversations_by_source": {r["source"]: r["conversations"] for r in health.count_by_source(self.table("conversations")).collect()}}

    def doctor(self) -> dict:
        return copies.inspect(self.store)

    def backup(self, output: str, overwrite: bool = False) -> dict:
        return copies.backup(self.store, output, overwrite)

    def restore(self, source: str, confirm_writer_stopped: bool = False) -> dict:
        report = copies.restore(self.store, source, confirm_writer_stopped)
        delete(self.spark, self._fts_path())
        return report


class Access(StrEnum):
    FULL = "full"
    READ_ONLY = "read_only"
    COLLECTOR = "collector"


WRITING_TOOLS = ("index_export", "import_conversations", "rebuild_summaries", "rebuild_embeddings")
READING_TOOLS = ("search_conversations", "get_conversation", "related_conversations", "index_stats")


class Tools:
    """The server's tools by name, JSON in and out. Read-only access lacks the writing ones; a collector only imports."""

    def __init__(self, index: Index, access: Access | str = Access.FULL):
        self.index, self.access = index, Access(access)

    def names(self) -> list[str]:
        return sorted({Access.FULL: WRITING_TOOLS + READING_TOOLS, Access.READ_ONLY: READING_TOOLS, Access.COLLECTOR: ("import_conversations",)}[self.access])

    def call(self, name: str, arguments: dict | None = None) -> object:
        if name not in self.names():
            raise PermissionError(f"no tool {name} with {self.access} access")
        return getattr(self, f"_{name}")(**(arguments or {}))

    @staticmethod
    def _rows(df: DataFrame) -> list[dict]:
        return [json.loads(x) for x in df.toJSON().collect()]  # one page

    def _index_export(self, archive_path: str, run_api_jobs: bool = False, force: bool = False) -> dict:
        return self.index.import_archive(archive_path, run_api_jobs, force)

    def _import_conversations(self, conversations: list[dict]) -> dict:
        if len(conversations) > IMPORT_CAP:
            raise ValueError(f"at most {IMPORT_CAP} conversations a call")
        return self.index.import_normalized(normalized.from_text(self.index.spark, json.dumps(conversations)))

    def _search_conversations(self, **options) -> list[dict]:
        return self._rows(self.index.search(**options))

    def _get_conversation(self, conversation_id: str, include_raw: bool = False) -> dict | None:
        return next(iter(self._rows(self.index.get_conversation(conversation_id, include_raw))), None)

    def _related_conversations(self, conversation_id: str, limit: int | None = None) -> list[dict]:
        return self._rows(self.index.related(conversation_id, searching.RELATED_LIMIT if limit is None else limit))

    def _rebuild_summaries(self, force: bool = False, conversation_ids: list[str] | None = None, limit: int | None = None) -> dict:
        return {"completed": self.index.rebuild_summaries(force, conversation_ids, limit)}

    def _rebuild_embeddings(self, force: bool = False, conversation_ids: list[str] | None = None, limit: int | None = None) -> dict:
        return {"completed": self.index.rebuild_embeddings(force, conversation_ids, limit)}

    def _index_stats(self) -> dict:
        return self.index.stats()


def default_home() -> str:
    return os.path.join(os.path.expanduser("~"), ".palimpsest")
