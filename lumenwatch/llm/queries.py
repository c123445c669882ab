"""The queries of this subpackage and their checking SQL."""

from lumenwatch.llm import attention_quality, decontaminate, html_text, jaccard, merkle, negatives, packing, pii, quality, secrets, token_files, toxicity, warc

MODULES = (quality, toxicity, jaccard, html_text, packing, decontaminate, pii, token_files, warc, secrets, merkle, negatives, attention_quality)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
