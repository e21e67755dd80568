"""Operators for large training-data pipelines.

One module for each operator; ``catalog`` holds the queries over the given
tables. Nothing outside this folder (but the driver's entry file and
``corpus_pipeline.py``) imports it.
"""
