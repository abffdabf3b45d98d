"""Training-data operators: scoring, mixing, sharding, search, redaction, de-duplication, formatting and packing."""
