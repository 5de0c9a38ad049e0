"""Training-data pipeline operators.

One module per operator; ``queries`` registers them.  Nothing outside this
subpackage (but ``__spark_entry__.py``, behind a guard, and
``corpus_pipeline.py``) imports it.
"""
