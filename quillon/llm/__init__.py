"""Training-data operators: tokenising, screening, deduplication, packing and formatting."""
