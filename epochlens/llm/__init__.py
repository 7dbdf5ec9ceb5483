"""Operators for training-data pipelines over text tables. Nothing outside this subpackage imports it."""
