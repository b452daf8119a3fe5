"""Operators for large training-data pipelines. Nothing else in querl imports this subpackage."""
