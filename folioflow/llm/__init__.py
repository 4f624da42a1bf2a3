"""Training-data operators: deduplication, search, counting, mixing, filtering, extraction and packing."""
