"""All registered queries; importing this imports the modules that register them."""

from __future__ import annotations

from chiasma.plans import cells, files, frames, maps, more, qc, reads  # noqa: F401
from chiasma.plans.registry import ORACLES, QUERIES


def queries():
    return QUERIES


def oracle_sql():
    return ORACLES
