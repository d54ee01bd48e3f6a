"""Training-data pipeline operators: deduplication, decontamination, scoring, packing.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
