"""Training-data operators: search, quality, deduplication, privacy, tokens and language models."""
