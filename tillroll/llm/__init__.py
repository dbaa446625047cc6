"""Operators for preparing large text and vector corpora, as Spark jobs.

Nothing else in the library imports this subpackage. Queries over the test
tables are in ``queries.py``; each operator module has a general interface of
its own. Common ground: ``words.py`` (vectorised tokenising of Arrow batches),
``chunks.py`` (exact global counts for the keys of each chunk of documents).
"""
