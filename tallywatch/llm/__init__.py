"""Operators of a training-data pipeline: filters, near copies, mixing, chat formatting."""
