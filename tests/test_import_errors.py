"""Errors of an import past the number that is listed."""

from palimpsest.api import Index
from palimpsest.streaming import sync as syncing


def test_errors_are_counted_past_the_listed_ones(spark, tmp_path):
    root = tmp_path / "rollouts"
    root.mkdir()
    for k in range(1003):
        (root / f"bad{k:04}.jsonl").write_text('{"type":"event_msg",broken\n')
    report = syncing.import_files(Index(spark, f"file://{tmp_path}/index"), "codex", [str(root)])
    assert (report["files_discovered"], report["skipped"], len(report["errors"]), report["errors_total"]) == (1003, 0, 1000, 1003)
