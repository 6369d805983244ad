"""Operators for large-scale training-data pipelines. Nothing else in ``kindred`` imports this subpackage."""
