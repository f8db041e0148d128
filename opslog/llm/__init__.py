"""Training-data operators: packing, token files, deduplication, filters and searches over corpora."""
