"""Operators of a training-data pipeline: quality, extraction, packing, near copies, search, tokens and scores."""
