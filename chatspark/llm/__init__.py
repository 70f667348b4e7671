"""Training-data operators: packing, deduplication, extraction, decontamination and binary output."""
