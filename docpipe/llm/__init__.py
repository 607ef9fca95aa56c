"""Training-data operators: mixing, language, language model, quality, extraction, tokens, duplicates, shards."""
