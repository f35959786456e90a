"""Operators for large text corpora (training-data preparation).

Nothing else in the library imports this subpackage; ``__spark_entry__``
registers its queries (``queries.py``) when it is present.
"""
