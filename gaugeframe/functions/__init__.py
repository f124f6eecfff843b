"""functions of the dataset-quality engine."""
