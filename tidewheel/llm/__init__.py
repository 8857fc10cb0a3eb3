"""Training-data operators: tokenising, near-duplicates, search, filtering, archives and packing."""
