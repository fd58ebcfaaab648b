"""Operators of a training-data pipeline: mixing, tokens, neighbours, filters, near copies, page text."""
