"""Training-data operators: quality, extraction, scanning, deduplication, decontamination, mixing and exact search."""
