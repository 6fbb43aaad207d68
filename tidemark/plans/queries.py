"""All registered queries and their oracles, but for the training-data operators'."""

from __future__ import annotations

from tidemark.plans import q_claims, q_models, q_pages, q_positions

MODULES = (q_positions, q_models, q_claims, q_pages)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}
