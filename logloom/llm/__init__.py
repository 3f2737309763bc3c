"""Operators for training-data pipelines. Nothing else in logloom imports this package."""
