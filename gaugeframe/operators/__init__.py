"""operators of the dataset-quality engine."""
