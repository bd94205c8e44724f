"""All registered queries of the library, with their SQL equivalents."""

from __future__ import annotations

from inkwell.plans import chunks, graph, relational, retrieval, scalars, storage, streams

MODULES = (chunks, graph, relational, retrieval, scalars, storage, streams)
QUERIES = {name: f for m in MODULES for name, f in m.catalogue.queries.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.catalogue.oracles.items()}
