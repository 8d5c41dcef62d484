"""Training-data pipeline operators: packing, quality, mixing, deduplication, scoring, binary output, chat formatting."""
