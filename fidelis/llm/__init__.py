"""Training-data operators: search, extraction, archives, de-duplication, packing, scoring."""
