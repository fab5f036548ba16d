"""The index end to end: exports, session files, upserts, invalidation, jobs, sync, backups, access tiers."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from palimpsest import schema
from palimpsest.api import Access, Index, Tools, summarise
from palimpsest.operators import jobs, upsert
from palimpsest.sources import exports, normalized, providers
from palimpsest.streaming import sync as syncing


def conversation(own_id, text="hello there", title="A title", **more):
    return {"source": "grok", "source_conversation_id": own_id, "title": title, "update_time": 10, "messages": [{"message_id": "m1", "role": "user", "text": text}], **more}


def normalised(spark, *items):
    return normalized.from_text(spark, json.dumps(items))


@pytest.fixture
def index(spark, tmp_path):
    return Index(spark, f"file://{tmp_path}/home", buckets=2)


def export_zip(path):
    tree = {
        "root": {"message": None},
        "a": {"message": {"id": "m2", "author": {"role": "assistant"}, "content": {"content_type": "text", "parts": ["Use FTS5 with Rust."]}, "create_time": 2.0}},
        "b": {"message": {"id": "m1", "author": {"role": "user"}, "content": {"content_type": "text", "parts": ["Rust SQLite FTS5 please"]}, "create_time": 1.0}},
        "c": {"message": {"id": "m3", "author": {"role": "user"}, "content": {"content_type": "multimodal_text", "parts": [{"asset_pointer": "sediment://file_00abc"}]}, "create_time": None}},
    }
    items = [{"conversation_id": "conv-rust", "title": "Index", "create_time": 1, "mapping": tree}, {"id": "conv-two", "mapping": {"x": {"message": {"content": {"content_type": "text", "parts": ["garden soil"]}}}}}]
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("conversations-000.json", json.dumps(items))
        z.writestr("u/audio/file_00abc.wav", b"RIFF")
        z.writestr("other.json", "[]")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("User Online Activity/Conversations__x-part-0001.zip", inner.getvalue())
        z.writestr("readme.txt", "x")


def test_export_import_search_and_related(index, tmp_path):
    export_zip(tmp_path / "x.zip")
    report = index.import_archive(f"file://{tmp_path}/x.zip", run_jobs=True)
    assert (report["conversations_indexed"], report["messages_indexed"], report["summaries_completed"], report["embeddings_completed"]) == (2, 4, 2, 2)
    said = index.table("messages").where("conversation_id = 'conv-rust'").orderBy("turn_index").collect()
    assert [m.message_id for m in said] == ["m3", "m1", "m2"]  # without a time first
    one = index.get_conversation("conv-rust", include_raw=True).first()
    assert one.transcript_text == "user: Rust SQLite FTS5 please\n\nassistant: Use FTS5 with Rust."
    assert [a.source_ref for a in one.attachments] == ["file_00abc"] and one.attachments[0].extension == "wav"
    assert json.loads(one.raw_json)["title"] == "Index"
    assert index.table("conversations").where("conversation_id = 'conv-two'").first().title == "(untitled conversation)"
    assert index.search(query="Rust SQLite FTS5", mode="fts").first().conversation_id == "conv-rust"
    assert index.search(query="garden soil", mode="semantic").first().conversation_id == "conv-two"
    assert [r.conversation_id for r in index.related("conv-rust").collect()] == ["conv-two"]
    assert index.stats()["conversations_by_source"] == {"chatgpt": 2} and index.stats()["attachments"] == 1
    assert index.doctor()["integrity_check"] == "ok"


def test_streamed_array_elements():
    text = ' [ {"a": [1, "]"]} , 2.5,"x", 12 ] '
    for chunk in (1, 3, 1000):
        assert list(exports.elements(io.StringIO(text), chunk)) == [{"a": [1, "]"]}, 2.5, "x", 12]
    with pytest.raises(ValueError):
        list(exports.elements(io.StringIO("[1, 2"), 4))


def test_changed_content_invalidates_and_requeues(spark, index):
    index.import_normalized(normalised(spark, conversation("1"), conversation("2")))
    index.resume()
    before = {r.conversation_id: r for r in index.table("conversations").collect()}
    assert before["grok:1"].embedding is not None
    index.import_normalized(normalised(spark, conversation("1"), conversation("2", text="other words")))
    after = {r.conversation_id: r for r in index.table("conversations").collect()}
    assert after["grok:1"].embedding == before["grok:1"].embedding
    assert after["grok:2"].embedding is None and after["grok:2"].summary_json is None and after["grok:2"].topic_tags == []
    pending = index.table("jobs").where("status = 'pending'").orderBy("kind").collect()
    assert [(j.conversation_id, j.kind, j.attempts) for j in pending] == [("grok:2", "embedding", 1), ("grok:2", "summary", 1)]
    assert index.table("messages").count() == 2 and index.table("runs").count() == 2


def test_importing_twice_changes_nothing(spark, index):
    rows = normalised(spark, conversation("1"), conversation("2", source="chatgpt"))
    index.import_normalized(rows)
    look = lambda: sorted(map(str, index.table("conversations").drop("archive_id", "ingested_at", "raw_conversation_zstd").collect()))
    first = look()
    index.import_normalized(rows)
    assert look() == first and index.table("conversations").count() == 2


def test_repeated_message_ids_keep_a_conversation_out(spark, index):
    twice = conversation("9", messages=[{"message_id": "m", "role": "user", "text": "a"}, {"message_id": "m", "role": "user", "text": "b"}])
    report = index.import_normalized(normalised(spark, conversation("1"), twice))
    assert report["conversations_indexed"] == 1 and report["errors"] == ["grok:9: repeated message id"]
    assert index.table("runs").first().status == "failed"


ROLLOUT = [
    {"timestamp": "2026-05-01T00:00:00Z", "type": "session_meta", "payload": {"id": "s-1"}},
    {"timestamp": "2026-05-01T00:00:01Z", "type": "turn_context", "payload": {"model": "big"}},
    {"timestamp": "2026-05-01T00:00:02.5Z", "type": "event_msg", "payload": {"type": "user_message", "message": "Fix  the\nparser"}},
    {"timestamp": "2026-05-01T00:00:03Z", "type": "event_msg", "payload": {"type": "agent_message", "message": "Done"}},
    {"timestamp": "2026-05-01T00:00:04Z", "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"text": "unused"}]}},
]


def lines(events, **dumps):
    return "\n".join(json.dumps(e, separators=(",", ":"), **dumps) for e in events) + "\n"


def test_rollout_parser():
    noise = '{"type":"response_item","payload":{"type":"function_call_output","output":"' + "x" * 5000 + "broken\n\n"
    got = providers.parse_rollout(lines(ROLLOUT) + noise, "/r/a.jsonl")
    assert (got["source_conversation_id"], got["title"], got["model"]) == ("s-1", "Fix the parser", "big")
    assert [m["role"] for m in got["messages"]] == ["user", "assistant"] and got["create_time"] == 1777593600.0 and got["update_time"] == 1777593604.0
    assert json.loads(got["raw"])["event_count"] == 6
    only_items = providers.parse_rollout(lines([ROLLOUT[0], ROLLOUT[4]]), "/r/b.jsonl")
    assert [m["text"] for m in only_items["messages"]] == ["unused"]
    assert providers.parse_rollout(lines(ROLLOUT[1:]), "/r/c.jsonl") is None
    with pytest.raises(ValueError):
        providers.parse_rollout('{"type":"event_msg", broken', "/r/d.jsonl".replace(" ", "")) or providers.parse_rollout('{"type":"event_msg",broken', "/r/d")


def test_session_parser():
    head = {"sessionId": "g1", "startTime": "2026-05-01T00:00:00Z", "model": "m"}
    said = [{"id": "1", "type": "user", "timestamp": 1777593600000, "content": "hi"}, {"type": "gemini", "content": [{"text": "a"}, {"text": "b"}]}, {"type": "info", "content": "no"}]
    for text in (json.dumps(head | {"messages": said}), lines([head, *said])):
        got = providers.parse_session(text, "/g/session-1.json")
        assert [m["text"] for m in got["messages"]] == ["hi", "a\nb"] and got["messages"][0]["create_time"] == 1777593600.0
        assert got["source_instance"] == "gemini-cli" and got["messages"][1]["message_id"].startswith("gemini-")
    with pytest.raises(ValueError):
        providers.parse_session('{"sessionId": "x"}', "/g/session-2.json")


def test_transcript_parser():
    said = [{"source": "USER", "type": "USER_INPUT", "created_at": "2026-05-01T00:00:00Z", "content": "go"}, {"source": "MODEL", "type": "PLANNER_RESPONSE", "content": "ok", "modelName": "mm"}, {"role": "user", "id": "d", "text": "x"}, {"role": "user", "id": "d", "text": "y"}]
    got = providers.parse_transcript(lines(said), "/h/brain/abc/.system_generated/logs/transcript.jsonl")
    assert (got["source_conversation_id"], got["model"], got["title"]) == ("abc", "mm", "go")
    assert [m["text"] for m in got["messages"]] == ["go", "ok", "x"]  # the first of a repeated id stays
    titled = providers.parse_transcript(lines([{"title": "T", "id": "own"}, said[0]]), "/x/t.jsonl")
    assert (titled["source_conversation_id"], titled["title"], len(titled["messages"])) == ("own", "T", 1)


def test_discovery(spark, tmp_path):
    for name in ("a/transcript.jsonl", "a/transcript_full.jsonl", "b/transcript.jsonl", "c/my_export.json", "c/note.json", "d/session-1.json", "d/session-2.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("{}")
    names = lambda p: sorted("/".join(r.path.split("/")[-2:]) for r in providers.files(spark, [str(tmp_path), str(tmp_path / "none")], providers.PROVIDERS[p]).select("path").collect())
    assert names("antigravity") == ["a/transcript_full.jsonl", "b/transcript.jsonl", "c/my_export.json"]
    assert names("gemini") == ["d/session-1.json"]


def test_sync_is_fail_closed_and_idempotent(index, tmp_path):
    root = tmp_path / "rollouts"
    root.mkdir()
    (root / "one.jsonl").write_text(lines(ROLLOUT))
    roots = [str(root)]
    report = index.sync("codex", roots, initial_since="2026-04-14", now=2e9)
    assert (report["files_discovered"], report["conversations_indexed"], report["messages_indexed"]) == (1, 1, 2)
    at = syncing.cursor_path(index, "codex")
    assert syncing.read_cursor(index, at) == 2e9
    syncing.write_cursor(index, at, 1777593600.0)
    (root / "bad.jsonl").write_text('{"type":"event_msg",broken\n')
    (root / "two.jsonl").write_text(lines([ROLLOUT[0] | {"payload": {"id": "s-2"}}, *ROLLOUT[1:]]))
    with pytest.raises(syncing.SyncIncomplete) as failed:
        index.sync("codex", roots, now=3e9)
    assert len(failed.value.report["errors"]) == 1 and syncing.read_cursor(index, at) == 1777593600.0
    assert index.table("conversations").count() == 2 and index.table("messages").count() == 4
    with pytest.raises(ValueError):
        index.sync("codex", roots, initial_since="never")
    assert index.export_provider("codex", [str(root / "one.jsonl")]).count() == 1


def test_skip_existing_keeps_files_without_an_id(spark, index, tmp_path):
    own = "01234567-89ab-cdef-0123-456789abcdef"
    meta = ROLLOUT[0] | {"payload": {"id": own}}
    (tmp_path / f"rollout-2026-{own}.jsonl").write_text(lines([meta, *ROLLOUT[1:]]))
    assert index.import_provider("codex", [str(tmp_path)])["conversations_indexed"] == 1
    (tmp_path / "plain.jsonl").write_text(lines(ROLLOUT))
    report = index.import_provider("codex", [str(tmp_path)], skip_existing=True)
    assert report["conversations_indexed"] == 1 and index.table("conversations").count() == 2


def test_stream_of_normalized_lines(index, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.jsonl").write_text(json.dumps(conversation("1")) + "\n\n" + json.dumps(conversation("2")) + "\n")
    for _ in range(2):
        syncing.stream_normalized(index, str(folder), str(tmp_path / "ck")).start().awaitTermination()
        assert index.table("conversations").count() == 2
    (folder / "2.jsonl").write_text(json.dumps(conversation("3")) + "\n")
    syncing.stream_normalized(index, str(folder), str(tmp_path / "ck")).start().awaitTermination()
    assert index.table("conversations").count() == 3


def test_normalized_forms(spark, tmp_path):
    items = [conversation("1"), conversation("2", create_time=5)]
    for name, text in {"array.json": json.dumps(items, indent=1), "lines.jsonl": lines(items), "one.json": json.dumps(items[1], indent=2)}.items():
        (tmp_path / name).write_text(text)
        got = normalized.read(spark, str(tmp_path / name)).orderBy("source_conversation_id").collect()
        assert [r.source_conversation_id for r in got] == (["2"] if name == "one.json" else ["1", "2"]) and got[-1].create_time == 5.0
    raw = lines(items).encode()
    assert normalized.from_stream(spark, io.BytesIO(raw + b"tail"), len(raw)).count() == 2
    with pytest.raises(ValueError):
        normalized.from_stream(spark, io.BytesIO(raw), len(raw) + 1)
    with pytest.raises(ValueError):
        normalized.from_text(spark, '{"source": "x"}')


def test_backup_and_restore(spark, index, tmp_path):
    index.import_normalized(normalised(spark, conversation("1")))
    index.backup(f"file://{tmp_path}/copy")
    with pytest.raises(FileExistsError):
        index.backup(f"file://{tmp_path}/copy")
    index.import_normalized(normalised(spark, conversation("2")))
    with pytest.raises(PermissionError):
        index.restore(f"file://{tmp_path}/copy")
    report = index.restore(f"file://{tmp_path}/copy", confirm_writer_stopped=True)
    assert report["restored"]["conversations"] == 1 and index.table("conversations").count() == 1
    assert Index(spark, report["rollback"]).table("conversations").count() == 2


def test_a_failed_backup_leaves_the_old_one(spark, index, tmp_path, monkeypatch):
    from palimpsest.sources import backup

    index.import_normalized(normalised(spark, conversation("1")))
    index.backup(f"file://{tmp_path}/copy")
    index.import_normalized(normalised(spark, conversation("2")))
    monkeypatch.setattr(backup, "_fingerprint", lambda store: store.home)
    with pytest.raises(OSError):
        index.backup(f"file://{tmp_path}/copy", overwrite=True)
    monkeypatch.undo()
    assert Index(spark, f"file://{tmp_path}/copy").table("conversations").count() == 1
    assert index.backup(f"file://{tmp_path}/copy", overwrite=True)["conversations"] == 2
    assert sorted(p.name for p in tmp_path.iterdir() if p.name.startswith("copy")) == ["copy"]


def test_bundles(spark, index, tmp_path):
    from palimpsest.sources import backup

    index.import_normalized(normalised(spark, conversation("1")))
    syncing.write_cursor(index, syncing.cursor_path(index, "codex"), 1.0)
    syncing.write_cursor(index, syncing.cursor_path(index, "gemini"), 2.0)
    export_zip(tmp_path / "x.zip")
    exports.stage(spark, f"file://{tmp_path}/x.zip", index.store.home)
    bundle = tmp_path / "bundle"
    assert backup.export_bundle(index.store, f"file://{bundle}")["files"] > 3
    assert bundle.stat().st_mode & 0o777 == 0o700
    with pytest.raises(FileExistsError):
        backup.export_bundle(index.store, f"file://{bundle}")
    moved = bundle.rename(tmp_path / "moved")
    other = Index(spark, f"file://{tmp_path}/other", buckets=2)
    other.import_normalized(normalised(spark, conversation("8")))
    report = backup.import_bundle(other.store, f"file://{moved}")
    assert other.table("conversations").count() == 1 and other.table("messages").count() == 1
    assert Index(spark, report["rollback"]).table("conversations").first().source_conversation_id == "8"
    assert [syncing.read_cursor(other, syncing.cursor_path(other, p)) for p in ("codex", "gemini")] == [None, 2.0]
    assert (tmp_path / "other/sources/x.zip").exists()
    (moved / "sources/x.zip").write_bytes(b"tampered")
    (moved / "sources/.x.zip.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="sources/x.zip"):
        backup.verify_bundle(spark, f"file://{moved}")
    (moved / "sources/x.zip").unlink()
    with pytest.raises(ValueError, match="sources/x.zip"):
        backup.verify_bundle(spark, f"file://{moved}")
    (moved / "sources/added.zip").write_bytes(b"escaped")
    with pytest.raises(ValueError, match="sources/added.zip"):
        backup.import_bundle(other.store, f"file://{moved}")


def test_of_repeated_conversations_the_last_copy_counts(spark, index, tmp_path):
    say = lambda own, text, token="": {"message": {"id": own, "author": {"role": "user"}, "content": {"content_type": "text", "parts": [text + token]}, "create_time": 1.0}}
    parts = []
    for text, update in (("first words", 9.0), ("last words file_b", 1.0)):
        inner = io.BytesIO()
        with zipfile.ZipFile(inner, "w") as z:
            items = [{"conversation_id": "c1", "title": text, "update_time": update, "mapping": {"a": say("m1", text)}}]
            z.writestr("conversations-000.json", json.dumps(items))
            z.writestr("conversations-001.json", json.dumps(items))
            z.writestr("u/file_b.png", b"x")
        parts.append(inner.getvalue())
    folder = tmp_path / "exports"
    folder.mkdir()
    for name, members in (("a.zip", parts), ("b.zip", [])):
        with zipfile.ZipFile(folder / name, "w") as z:
            for i, part in enumerate(members):
                z.writestr(f"Conversations__x-{i}.zip", part)
            z.writestr("readme.txt", "x")
    report = index.import_archive(f"file://{folder}")
    assert (report["conversations_indexed"], report["messages_indexed"], report["errors"]) == (1, 1, [])
    assert index.table("conversations").first().title == "last words file_b" and index.table("messages").first().normalized_text == "last words file_b"
    assert [a.source_ref for a in index.table("attachments").collect()] == ["file_b"]
    import hashlib

    ledger = {r.archive_path.rsplit("/", 1)[1]: r for r in index.table("archives").collect()}
    assert {n: r.sha256_hex for n, r in ledger.items()} == {n: hashlib.sha256((folder / n).read_bytes()).hexdigest() for n in ("a.zip", "b.zip")}
    assert ledger["a.zip"].size_bytes == (folder / "a.zip").stat().st_size and index.table("conversations").first().archive_id == ledger["a.zip"].id
    assert not [p for p in (tmp_path / "home").iterdir() if p.name.startswith("unpacked")]


def test_two_writers_do_not_lose_rows(spark, index):
    from palimpsest.sources.store import ConcurrentWrite

    index.import_normalized(normalised(spark, conversation("1")), reindex=False)
    slow = Index(spark, index.store.home)
    slow.store.begin()
    index.import_normalized(normalised(spark, conversation("2")), reindex=False)
    with pytest.raises(ConcurrentWrite):
        slow.store.commit({"runs": slow.table("runs")})
    claim = slow.store._claim(slow.store.manifest()["version"] + 1)
    with pytest.raises(ConcurrentWrite):
        index.import_normalized(normalised(spark, conversation("3")), reindex=False)
    from palimpsest.sources.store import delete

    delete(spark, claim)
    index.import_normalized(normalised(spark, conversation("3")), reindex=False)
    assert index.table("conversations").count() == 3 and len(index.store.versions()) == 3
    assert index.store.vacuum() >= 0 and len(index.store.versions()) == 1 and index.table("conversations").count() == 3


def test_buckets_double_when_they_get_large(spark, tmp_path, monkeypatch):
    from palimpsest.sources import store

    monkeypatch.setattr(store, "BUCKET_BYTES", 6_000)
    index = Index(spark, f"file://{tmp_path}/home", buckets=1)
    index.import_normalized(normalised(spark, conversation("1")), reindex=False)
    index.import_normalized(normalised(spark, *(conversation(str(i)) for i in range(40))), reindex=False)
    n = index.store.manifest()["buckets"]
    assert n > 1 and n & (n - 1) == 0 and index.table("conversations").count() == 40 and index.table("messages").count() == 40
    own = index.store.touched(index.table("conversations").where("source_conversation_id = '7'"))
    assert len(own) == 1 and index.store.part("conversations", own).where("source_conversation_id = '7'").count() == 1
    index.import_normalized(normalised(spark, conversation("7", text="new")), reindex=False)
    assert index.table("conversations").count() == 40 and index.doctor()["integrity_check"] == "ok"


def test_passes_write_only_the_buckets_of_their_targets(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/home", buckets=8)
    index.import_normalized(normalised(spark, *(conversation(str(i)) for i in range(30))), reindex=False)
    before = index.store.manifest()["tables"]["conversations"]
    assert index.rebuild_summaries(limit=1) == 1 and index.rebuild_embeddings(limit=1) == 1
    after = index.store.manifest()["tables"]["conversations"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert index.rebuild_embeddings(limit=1) == 0


def test_access_tiers(spark, index):
    assert len(Tools(index).names()) == 8
    assert Tools(index, Access.READ_ONLY).names() == ["get_conversation", "index_stats", "related_conversations", "search_conversations"]
    collector = Tools(index, "collector")
    assert collector.names() == ["import_conversations"]
    assert collector.call("import_conversations", {"conversations": [conversation("1")]})["conversations_indexed"] == 1
    with pytest.raises(PermissionError):
        collector.call("index_stats")
    with pytest.raises(ValueError):
        collector.call("import_conversations", {"conversations": [conversation(str(i)) for i in range(101)]})
    reader = Tools(index, "read_only")
    assert reader.call("search_conversations", {"query": "hello", "mode": "fts"})[0]["conversation_id"] == "grok:1"
    assert reader.call("get_conversation", {"conversation_id": "grok:1"})["message_count"] == 1


def test_job_transitions_and_targets(spark):
    none = spark.createDataFrame([], schema.JOBS)
    ids = spark.createDataFrame([("a",), ("b",)], "conversation_id string")
    table = jobs.upsert(none, jobs.enqueue(ids))
    table = jobs.upsert(table, jobs.changes(ids.where("conversation_id = 'a'"), ["summary"], "running", 1))
    table = jobs.upsert(table, jobs.changes(ids.where("conversation_id = 'a'"), ["summary"], "complete"))
    got = {(r.conversation_id, r.kind): r for r in table.collect()}
    assert len(got) == 4 and got["a", "summary"].attempts == 1 and got["a", "summary"].completed_at is not None
    assert got["b", "summary"].status == "pending" and got["b", "summary"].completed_at is None
    rows = spark.createDataFrame([("a", "xx", 1.0, None, None), ("b", "xxxx", 2.0, None, None), ("c", "x", None, None, None)], "conversation_id string, transcript_text string, create_time double, summary_json string, embedding array<float>")
    assert [r[0] for r in jobs.targets(rows, table, "summary").collect()] == ["c", "b", "a"]
    assert [r[0] for r in jobs.targets(rows, table, "summary", ids=["a", "b"], limit=1).collect()] == ["b"]
    assert jobs.targets(rows, table, "embedding").count() == 0


def test_migration_fills_identity(spark):
    old = spark.createDataFrame([("x", "t")], "conversation_id string, title string")
    row = upsert.migrate(old, "conversations").first()
    assert (row.source, row.source_conversation_id) == ("chatgpt", "x") and row.ingested_at is not None


def test_failing_summariser_gets_the_condensed_transcript():
    seen = []

    def picky(text):
        seen.append(text)
        if len(seen) == 1:
            raise RuntimeError("too long")
        return {"abstract_text": "a", "key_points": [], "candidate_topics": [], "entities": [], "risk_flags": ["contains_pii", "financial"], "site_usefulness": "", "redaction_notes": []}

    assert summarise("\n".join(f"l{i}" for i in range(60)), picky)["risk_flags"] == ["contains_pii"]
    assert "condensed" in seen[1]


def test_asset_index(spark):
    paths = spark.createDataFrame([("a/file_1.png",), ("b/file_1.png",), ("c/none",)], "path string")
    assert [(r.token, r.paths) for r in upsert.asset_index(paths).collect()] == [("file_1", ["a/file_1.png", "b/file_1.png"])]
    tokens = spark.createDataFrame([("c1", "file_1"), ("c1", "file_1"), ("c2", "file_9")], "conversation_id string, token string")
    assert upsert.attachment_rows(tokens, paths).where(F.col("source_ref") == "file_1").count() == 2
