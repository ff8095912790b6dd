"""Training-data operators: packing, counting, deduplication, decontamination, extraction and scoring."""
