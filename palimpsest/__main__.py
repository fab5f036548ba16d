"""Command line: python -m palimpsest COMMAND. Every command prints JSON."""

from __future__ import annotations

import argparse
import json
import sys

from palimpsest.api import Access, Index, Tools, default_home
from palimpsest.schema import SearchMode
from palimpsest.session import session
from palimpsest.sources import backup, normalized
from palimpsest.streaming import remote
from palimpsest.streaming.backfill import backfill
from palimpsest.streaming.sync import INITIAL_SINCE, OVERLAP_HOURS

PROVIDERS = ("codex", "gemini", "antigravity")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="palimpsest")
    top.add_argument("--home", default=f"file://{default_home()}")
    top.add_argument("--master", default="local[*]")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: tuple[str, dict]) -> None:
        own = sub.add_parser(name)
        for flag, options in arguments:
            own.add_argument(flag, **options)

    yes, number, many = {"action": "store_true"}, {"type": int}, {"action": "append", "default": []}
    roots = ("--root", many | {"dest": "roots"})
    add("import", ("--archive", {"required": True}), ("--mode", {"choices": ["copy", "adopt"]}), ("--run-jobs", yes), ("--force", yes))
    for name in PROVIDERS:
        add(f"import-{name}", roots, ("--since", {}), ("--skip-existing", yes))
        add(f"export-{name}", roots, ("--since", {}))
        add(f"sync-{name}", roots, ("--initial-since", {"default": INITIAL_SINCE}), ("--overlap-hours", {"type": float, "default": OVERLAP_HOURS}))
    add("import-normalized", ("--path", {"required": True}), ("--stdin-bytes", number))
    add("resume")
    add("stats")
    add(
        "search", ("query", {"nargs": "?"}), ("--mode", {"choices": list(SearchMode)}), ("--date-from", {"type": float}), ("--date-to", {"type": float}), ("--model", {}),
        ("--source", many | {"dest": "sources"}), ("--risk-flag", many | {"dest": "risk_flags"}), ("--topic-tag", many | {"dest": "topic_tags"}), ("--limit", number),
    )
    add("show", ("conversation_id", {}), ("--include-raw", yes))
    add("related", ("conversation_id", {}), ("--limit", {"type": int, "default": 10}))
    add("summarize-missing", ("--force", yes), ("--limit", number))
    add("embed-missing", ("--force", yes), ("--limit", number))
    add("reindex-fts")
    add("backfill", ("--summaries", {"type": int, "default": 5}), ("--embeddings", {"type": int, "default": 64}))
    add("push", ("provider", {"choices": PROVIDERS}), ("destination", {}), roots)
    add("backup", ("--output", {"required": True}), ("--overwrite", yes))
    add("restore", ("--input", {"required": True}), ("--confirm-writer-stopped", yes))
    add("export-bundle", ("--output", {"required": True}), ("--without-sources", yes))
    add("import-bundle", ("--bundle", {"required": True}))
    add("doctor")
    add("tool", ("name", {}), ("--arguments", {"default": "{}"}), ("--access", {"choices": list(Access), "default": "full"}))
    return top


def run(index: Index, a: argparse.Namespace) -> object:
    rows = Tools._rows
    kind, _, provider = a.command.partition("-")
    if provider in PROVIDERS:
        if kind == "sync":
            return index.sync(provider, a.roots, initial_since=a.initial_since, overlap_hours=a.overlap_hours)
        return index.import_provider(provider, a.roots, a.since, a.skip_existing) if kind == "import" else rows(index.export_provider(provider, a.roots, a.since))
    if a.command == "import-normalized":
        found = normalized.from_stream(index.spark, sys.stdin.buffer, a.stdin_bytes) if a.path == "-" else normalized.read(index.spark, a.path)
        return index.import_normalized(found, a.path)
    if a.command == "search":
        return rows(index.search(**{k: getattr(a, k) for k in ("query", "mode", "date_from", "date_to", "model", "sources", "risk_flags", "topic_tags", "limit")}))
    commands = {
        "import": lambda: index.import_archive(a.archive, a.run_jobs, a.force, a.mode),
        "resume": index.resume,
        "stats": index.stats,
        "show": lambda: next(iter(rows(index.get_conversation(a.conversation_id, a.include_raw))), None),
        "related": lambda: rows(index.related(a.conversation_id, a.limit)),
        "summarize-missing": lambda: {"completed": index.rebuild_summaries(a.force, None, a.limit)},
        "embed-missing": lambda: {"completed": index.rebuild_embeddings(a.force, None, a.limit)},
        "reindex-fts": index.reindex,
        "backfill": lambda: backfill(index, a.summaries, a.embeddings),
        "push": lambda: remote.push(index, a.provider, a.roots, a.destination),
        "backup": lambda: index.backup(a.output, a.overwrite),
        "restore": lambda: index.restore(a.input, a.confirm_writer_stopped),
        "export-bundle": lambda: backup.export_bundle(index.store, a.output, not a.without_sources),
        "import-bundle": lambda: backup.import_bundle(index.store, a.bundle),
        "doctor": index.doctor,
        "tool": lambda: Tools(index, a.access).call(a.name, json.loads(a.arguments)),
    }
    return commands[a.command]()


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    print(json.dumps(run(Index(session(a.master), a.home), a), indent=2, default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
