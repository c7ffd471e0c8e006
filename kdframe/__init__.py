"""PySpark data engine for language-model distillation jobs.

Everything is a lazy DataFrame plan: see ``operators`` for the dataset, token, loss, evaluation
and report operators, ``sources`` for readers and writers, ``streaming`` for the incremental
flows and ``plans`` for the registered queries.
"""
