"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import byte_bpe, chat, collocations, cotraining, fill_middle, jaccard_join, language_id, mixing, quality_rules, sharding, toxicity, url_filter, weighted_sampling

MODULES = (jaccard_join, weighted_sampling, byte_bpe, url_filter, quality_rules, language_id, toxicity, sharding, mixing, cotraining, collocations, fill_middle, chat)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
