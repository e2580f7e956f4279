"""All registered queries, and their SQL twins."""

from brightloom import queries, store_queries

QUERIES = queries.QUERIES | store_queries.QUERIES
ORACLES = queries.ORACLES | store_queries.ORACLES
