"""Training-data operators: scoring, filtering, sharding, deduplication, mixing, encoding."""
