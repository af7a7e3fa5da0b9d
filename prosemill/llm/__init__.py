"""Training-data operators: scoring, deduplication, archives, search, packing, extraction."""
