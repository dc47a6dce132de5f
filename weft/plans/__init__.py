"""Registered queries over the driver tables, with their DuckDB oracles."""

from weft.plans import answering, catalog, evaluation, intake, language, operations, selection
from weft.plans.registry import merged

QUERIES, ORACLES = merged(catalog, intake, language, selection, evaluation, answering, operations)
