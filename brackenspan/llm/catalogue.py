"""Every query of this subpackage, with its SQL where SQL can express it."""

from brackenspan.llm import ann, bpe, jaccard, language_id, mixing, ogg, quality, sharding, token_counts, toxicity

_ALL = (bpe, sharding, language_id, token_counts, jaccard, ogg, ann, toxicity, mixing, quality)
QUERIES = {name: query for m in _ALL for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _ALL for name, sql in m.ORACLES.items()}
