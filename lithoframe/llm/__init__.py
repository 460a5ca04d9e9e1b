"""Training-data operators: ten components for corpus preparation, each a Spark job.

Nothing else in the library imports this subpackage; ``__spark_entry__.py`` adds its
queries when it can be imported.
"""
