"""Operators of a training-data pipeline: filtering, deduplication, scoring and packing.

Every operator takes and returns DataFrames.  ``finloom.llm.registry`` lists the
queries; nothing else in the library imports this subpackage.
"""
