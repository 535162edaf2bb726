"""Operators for large training-data pipelines: text similarity, quality, packing, extraction and redaction."""
