"""Training-data operators: toxicity, token counts, deduplication, mixing, search, fingerprints, formatting, tokenization."""
