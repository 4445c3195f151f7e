"""The queries of this subpackage and their SQL."""

from quern.llm import collocations, html_extraction, line_dedup, manifest, packing, piece_codec, quality, secret_scan, simhash, suffix_dedup, token_counts, toxicity, vector_search

MODULES = (suffix_dedup, packing, token_counts, line_dedup, toxicity, quality, vector_search, secret_scan, piece_codec, simhash, collocations, manifest, html_extraction)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
