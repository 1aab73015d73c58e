"""Training-data operators: packing, extraction, tokenizing, fingerprints, quality, deduplication, search."""
