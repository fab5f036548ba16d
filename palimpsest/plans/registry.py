"""Every registered query and the SQL that restates it."""

from __future__ import annotations

from palimpsest.plans import oracles, queries as plain, staged_oracles
from palimpsest.plans import staged as staged  # registers its queries


def queries() -> dict:
    return dict(plain.QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracles.ORACLES | staged_oracles.ORACLES
