"""Operators that prepare training text: quality, secrets, tokens, licences, shards,
packing, deduplication, language and nearest neighbours."""
