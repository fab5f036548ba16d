"""Draining the job queue: stale jobs first, then summaries, then embeddings, until nothing moves."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TYPE_CHECKING

from palimpsest.operators import jobs

if TYPE_CHECKING:
    from palimpsest.api import Index

SUMMARIES, EMBEDDINGS, SLEEP_S = 5, 64, 20.0


def backfill(index: Index, summaries: int = SUMMARIES, embeddings: int = EMBEDDINGS, stalls: int = 3, sleep: Callable[[float], None] = time.sleep, pause: float = SLEEP_S) -> dict:
    """Passes over the queue. A pass that completes nothing is a stall; after so many in a row, or once no target is
    left, it ends with a reindex if anything was done."""
    index.reset_stale_jobs()
    done, idle = {"summaries": 0, "embeddings": 0}, 0
    while idle < stalls:
        moved = index.rebuild_summaries(limit=summaries)
        done["summaries"] += moved
        if not moved:
            made = index.rebuild_embeddings(limit=embeddings)
            done["embeddings"] += made
            moved = made
        left = any(not jobs.targets(index.table("conversations"), index.table("jobs"), kind).isEmpty() for kind in ("summary", "embedding"))
        if not left:
            break
        idle = 0 if moved else idle + 1
        sleep(pause)
    if any(done.values()):
        index.reindex()
    return done | {"stalled": idle >= stalls}
