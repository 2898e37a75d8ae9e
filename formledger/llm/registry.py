"""The training-text queries by name, and the SQL of those that SQL can express."""

from formledger.llm import audio, fill_in_middle, hard_negatives, language_id, mixing, ngram_join, packing, pitman_yor, quality_classifier, quality_rules, secret_scan, substring_dedup, url_filter

_MODULES = (
    audio, fill_in_middle, hard_negatives, language_id, mixing, ngram_join, packing, pitman_yor, quality_classifier, quality_rules, secret_scan, substring_dedup, url_filter,
)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
