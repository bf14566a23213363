"""Training-data operators: ten corpus-scale passes over documents and embeddings.

Nothing outside this subpackage imports it. ``queries.py`` registers the
contract queries, ``sql.py`` holds the DuckDB statements that check them.
"""
