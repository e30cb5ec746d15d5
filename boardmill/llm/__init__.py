"""Training-data operators: deduplication, decontamination, scoring, counting, mixing.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
