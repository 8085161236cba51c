"""Training-data operators: language ID, fingerprints, extraction, deduplication, packing, tokens, quality."""
