"""Operators for training-data pipelines over web-scale text; nothing else here imports this package."""
