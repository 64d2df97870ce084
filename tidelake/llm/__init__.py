"""Training-data operators: ten distributed operators over tables of documents and vectors.

Each module holds one operator with its own general interface; ``queries`` holds the thin
``opN_<name>`` queries.  Nothing outside this subpackage imports it.
"""
