"""Training-data operators: language, quality, deduplication, mixing, tokens, archives, search."""
