"""streaming of the dataset-quality engine."""
