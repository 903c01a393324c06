"""All registered queries of the main library with their SQL."""

from __future__ import annotations

from netledger.plans import capture_queries, composite_queries, contract_queries, facility_queries, geocoding_queries, inequality_queries, linkage_queries, list_queries, notice_queries, place_queries, register_queries, spatial_queries, statistics_queries, study_queries, temporal_queries

_MODULES = (capture_queries, composite_queries, contract_queries, facility_queries, geocoding_queries, inequality_queries, linkage_queries, list_queries, notice_queries, place_queries, register_queries, spatial_queries, statistics_queries, study_queries, temporal_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
