"""Training-data operators: one module per operator, queries in ``queries``.

Nothing outside this subpackage imports it, apart from the guarded import in
``__spark_entry__`` and ``corpus_pipeline``.
"""
