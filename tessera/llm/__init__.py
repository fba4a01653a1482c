"""Training-data operators: deduplication, search, formatting, tokenizing, packing, filtering."""
