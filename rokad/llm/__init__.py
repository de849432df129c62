"""Training-data operators: language, privacy, duplicates, mixing, tokens, packing. Nothing else in rokad imports this."""
