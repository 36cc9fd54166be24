"""Training-data operators: deduplication, search, filtering, mixing and materialisation."""
