"""Training-data operators: extraction, deduplication, scoring, packing and joins over text tables."""
