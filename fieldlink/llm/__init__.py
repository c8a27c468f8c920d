"""Operators of a training-data pipeline: packing, tokens, search, filters and near copies."""
