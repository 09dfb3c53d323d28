"""Training-data operators: search, de-duplication, extraction, privacy, language, quality, scoring, tokens, URLs."""
