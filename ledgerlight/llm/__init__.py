"""Training-data operators: extraction, dedup, filtering, packing and sharding of text corpora."""
