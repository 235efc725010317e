"""Training-data operators: URL filters, decontamination, deduplication, language, mixing, tokens, quality, secrets."""
