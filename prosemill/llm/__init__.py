"""Training-data operators.

Nothing outside this subpackage and ``corpus_pipeline.py`` imports it; the
driver entry adds its queries only when it is present.
"""
