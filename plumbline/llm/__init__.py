"""Operators of a training-data pipeline: ten operators and their registered queries."""
