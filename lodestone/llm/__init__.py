"""Operators of a training-data pipeline: dedup, language ID, extraction, decontamination, mixing, sharding and the like.

Nothing outside this subpackage imports it; the folder can be deleted without breaking the search engine.
"""
