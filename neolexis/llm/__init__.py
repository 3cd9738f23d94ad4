"""Training-data operators: output, personal data, duplicates, packing, mixing, quality, search, archives."""
