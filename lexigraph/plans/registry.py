"""All queries of the core package and their SQL."""

from __future__ import annotations

from lexigraph.plans import general, reference

QUERIES = {**general.QUERIES, **reference.QUERIES}
SQL = {**general.SQL, **reference.SQL}
