"""Operators on text and records for training-data pipelines. Nothing outside this subpackage imports it."""
