"""The queries of this subpackage and the SQL to hold them against."""

from chronofact.llm import exact_dedup, kmeans, language, line_dedup, mixing, near_dedup, packing, quality, runs, sharding, suffix_dedup, topk, warc

_MODULES = [suffix_dedup, near_dedup, warc, mixing, exact_dedup, packing, topk, language, sharding, line_dedup, runs, kmeans, quality]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
