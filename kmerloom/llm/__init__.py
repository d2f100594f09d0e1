"""Training-data operators on Spark: dedup, filtering, decontamination, mixing, archives."""
