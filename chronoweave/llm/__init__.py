"""Training-data operators: archives, filters, scoring, search, packing, deduplication, redaction."""
