"""Training-data operators: sharding, deduplication, decontamination, archives,
search, tokenising and scoring of text corpora."""
