"""Training-data operators: filtering, extraction, dedup, archives, scoring and tokens."""
