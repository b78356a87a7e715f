"""Training-data operators: ten document operators and the corpus pipeline's building blocks.

Nothing outside this folder (and corpus_pipeline.py) imports it.
"""
