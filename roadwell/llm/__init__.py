"""Training-data operators: each module holds one operator over a corpus of documents.

Nothing outside this subpackage imports it.
"""
