"""Training-data operators: language ID, deduplication, scoring, tokenising, packing, search."""
