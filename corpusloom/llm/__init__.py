"""Training-data operators: scoring, filtering, deduplication, decontamination and mixing of documents."""
