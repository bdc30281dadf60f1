"""Training-data operators: one module per operator, queries in ``queries.py``.

Nothing outside this subpackage imports it, apart from the guarded import in
``__spark_entry__.py`` and ``corpus_pipeline.py`` at the repository top.
"""
