"""Operators of a training-data pipeline; each module holds one operator, `queries` the registered forms."""
