"""Operators for preparing training text: one module each; ``entries`` registers their queries.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
