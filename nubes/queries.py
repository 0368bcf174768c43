"""The queries of the point-cloud engine and, where DuckDB can express them, their SQL."""

from nubes.plans import analysis_queries, cloud_queries, data_queries, pool_queries, stat_queries, trial_queries

QUERIES: dict = {**cloud_queries.QUERIES, **stat_queries.QUERIES, **data_queries.QUERIES, **trial_queries.QUERIES, **pool_queries.QUERIES, **analysis_queries.QUERIES}
ORACLES: dict = {**cloud_queries.ORACLES, **stat_queries.ORACLES, **data_queries.ORACLES, **trial_queries.ORACLES, **pool_queries.ORACLES, **analysis_queries.ORACLES}
