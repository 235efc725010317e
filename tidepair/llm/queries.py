"""All queries of this subpackage and of the pipeline, and their SQL twins."""

import corpus_pipeline

from . import dedup_queries, map_queries, native_queries

QUERIES = {**native_queries.QUERIES, **map_queries.QUERIES, **dedup_queries.QUERIES, "pipeline": corpus_pipeline.run}
ORACLES = {**native_queries.ORACLES}
