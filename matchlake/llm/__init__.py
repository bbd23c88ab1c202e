"""Training-data operators: deduplication, mixing, search, archives, scoring, tokens, languages, chat."""
