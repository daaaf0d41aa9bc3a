"""Sources, sinks and the dataset registry."""
