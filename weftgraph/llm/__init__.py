"""Training-data operators: one module for each, with a small general interface.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
