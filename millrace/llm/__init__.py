"""Training-data operators: dedup, packing, tokens, scans and filters over document tables."""
