"""Training-data operators: dedup, search, packing, filters, mixing."""
