"""Training-data operators over a table of documents.

Nothing outside this subpackage imports it; ``queries.py`` registers its
queries and ``corpus_pipeline.py`` at the repository top chains five of them.
"""
