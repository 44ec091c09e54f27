"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it; ``corpus_pipeline.py`` and the
guarded block in ``__spark_entry__.py`` are its only users.
"""
