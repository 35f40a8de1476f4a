"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from palimpsest.llm import chat_format, decontaminate, jaccard_join, language_id, lm_scoring, mixing, pii, spotsigs, substring_dedup, warc

MODULES = (pii, lm_scoring, jaccard_join, substring_dedup, language_id, warc, mixing, decontaminate, spotsigs, chat_format)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
