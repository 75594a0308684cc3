"""The queries of this subpackage and their SQL, gathered from its modules."""

from __future__ import annotations

from marlspike.llm import embedding_dedup, exact_dedup, hard_negatives, html_extraction, jaccard_join, language_id, line_dedup, packing, pii, quality_rules, repeats, segmentation, whitening

MODULES = (language_id, exact_dedup, packing, line_dedup, embedding_dedup, jaccard_join, repeats, html_extraction, pii, segmentation, whitening, quality_rules, hard_negatives)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
