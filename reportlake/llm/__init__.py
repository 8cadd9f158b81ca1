"""Training-data operators: deduplication, sharding, tokenisation, archives, scoring."""
