"""Operators of a training-data pipeline: counting, storing, de-duplicating, screening and packing documents.

Nothing else in the library imports this subpackage; its registered queries are in ``llm.queries``.
"""
