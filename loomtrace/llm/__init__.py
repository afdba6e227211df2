"""Operators for training-data pipelines, the queries over them and their comparison SQL."""
