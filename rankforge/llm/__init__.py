"""Operators of a training-data pipeline: each module holds one operator, its docstring states its results in every corner case."""
