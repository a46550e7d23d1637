"""Operators for training-data pipelines; nothing else in voxtable imports this subpackage."""
