"""Training-data operators: quality, deduplication, decontamination, packing, language, secrets, similarity, toxicity."""
