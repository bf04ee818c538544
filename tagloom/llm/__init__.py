"""Training-data operators: deduplication, filtering, scoring, tokens and packing."""
