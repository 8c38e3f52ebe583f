"""Training-data operators: mixing, filtering, deduplication, scanning and scoring of documents."""
