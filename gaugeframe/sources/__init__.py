"""sources of the dataset-quality engine."""
