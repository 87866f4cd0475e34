"""Training-data operators: extraction, language ID, licence scan, packing, mixing, quality, token files, dedup, media.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
