"""Operators that a training-data pipeline needs. Optional: nothing outside this folder imports it."""
