"""Every registered query of the core with its SQL."""

from __future__ import annotations

from lodegraph.plans import evidence, training

QUERIES = {**evidence.QUERIES, **training.QUERIES}
SQL = {**evidence.SQL, **training.SQL}
