"""Registered queries (importing this package fills the registry)."""

from tracewise.plans.registry import QUERIES, ORACLES, OPERATORS  # noqa: F401
from tracewise.plans import (catalog_compare, catalog_consensus, catalog_library, catalog_memory, catalog_risk,  # noqa: F401
                             catalog_convert, catalog_graph, catalog_io, catalog_lookup, catalog_stream, catalog_text,
                             catalog_validate)
