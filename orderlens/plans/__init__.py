"""Composed jobs and the query registry used by ``__spark_entry__``."""
