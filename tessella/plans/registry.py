"""All queries but those for training data: name -> (query, SQL or None)."""

from __future__ import annotations

from tessella.plans import game_queries, image_queries, lookup_queries, model_queries, stream_queries, table_queries, training_queries

QUERIES = {**table_queries.QUERIES, **game_queries.QUERIES, **model_queries.QUERIES, **stream_queries.QUERIES, **image_queries.QUERIES, **lookup_queries.QUERIES, **training_queries.QUERIES}
