"""Training-data operators: sharding, tokens, filters, deduplication, language, packing, quality."""
