"""Per-read dynamic programs in numpy. Spark decides which reads meet in a batch."""
