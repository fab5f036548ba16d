import json

from palimpsest.__main__ import parser, run
from palimpsest.api import Index, Tools
from palimpsest.sources import exports, normalized
from palimpsest.streaming import remote, sync
from palimpsest.streaming.backfill import backfill
from tests.test_index import ROLLOUT, conversation, lines


def test_push_twice_gives_one_conversation_and_a_cursor_for_the_destination(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.jsonl").write_text(lines(ROLLOUT))
    here, there = (Index(spark, f"file://{tmp_path}/{n}", buckets=2) for n in ("here", "there"))
    collector = Tools(there, "collector")
    write = lambda batch: collector.call("import_conversations", {"conversations": batch})
    for _ in range(2):
        assert remote.push(here, "codex", [str(tmp_path / "r")], "http://writer", write, now=1777593600.0)["conversations_sent"] == 1
    assert there.table("conversations").count() == 1 and there.table("messages").count() == 2
    assert sync.read_cursor(here, sync.cursor_path(here, "codex", "http://writer")) == 1777593600.0
    assert sync.read_cursor(here, sync.cursor_path(here, "codex", "http://other")) is None


def test_executors_send_batches_to_a_server(spark, tmp_path):
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    got = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            call = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            got.append(call["params"]["arguments"]["conversations"])
            answer = json.dumps({"jsonrpc": "2.0", "id": 1, "result": {"ok": True}} if len(got) else {}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(answer)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    (tmp_path / "r").mkdir()
    for k in range(7):
        (tmp_path / "r" / f"{k}.jsonl").write_text(lines([ROLLOUT[0] | {"payload": {"id": f"s-{k}"}}, *ROLLOUT[1:]]))
    index = Index(spark, f"file://{tmp_path}/here", buckets=2)
    report = remote.push(index, "codex", [str(tmp_path / "r")], f"http://127.0.0.1:{server.server_port}", size=3, now=1777593600.0, writers=2)
    server.shutdown()
    assert report["conversations_sent"] == 7 and sorted(c["source_conversation_id"] for b in got for c in b) == [f"s-{k}" for k in range(7)]
    assert all(len(b) <= 3 for b in got) and got[0][0]["messages"][0]["text"] == "Fix  the\nparser"


def test_backfill_drains_the_queue(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/home", buckets=1)
    index.import_normalized(normalized.from_text(spark, json.dumps([conversation("1"), conversation("2"), conversation("3")])))
    assert backfill(index, summaries=2, sleep=lambda s: None) == {"summaries": 3, "embeddings": 3, "stalled": False}
    assert index.stats()["embeddings_complete"] == 3


def test_staging_keeps_a_file_of_the_same_length(spark, tmp_path):
    source = tmp_path / "x.zip"
    source.write_bytes(b"12345")
    at = exports.stage(spark, f"file://{source}", f"file://{tmp_path}/home")
    assert source.exists() and exports.stage(spark, f"file://{source}", f"file://{tmp_path}/home") == at
    source.write_bytes(b"123456")
    exports.stage(spark, f"file://{source}", f"file://{tmp_path}/home", "adopt")
    assert not source.exists() and (tmp_path / "home/sources/x.zip").read_bytes() == b"123456"


def test_command_line(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/home", buckets=1)
    (tmp_path / "n.jsonl").write_text(json.dumps(conversation("1")) + "\n")
    call = lambda *argv: run(index, parser().parse_args(argv))
    assert call("import-normalized", "--path", str(tmp_path / "n.jsonl"))["conversations_indexed"] == 1
    assert call("search", "hello")[0]["conversation_id"] == "grok:1" if call("resume") else False
    assert call("search", "--source", "other") == [] and call("show", "grok:1")["title"] == "A title"
    assert call("doctor")["integrity_check"] == "ok" and call("tool", "index_stats")["conversations"] == 1
