"""Operators of a training-data pipeline. Nothing else in cairnflow imports this subpackage."""
