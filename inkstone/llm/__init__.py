"""Training-data operators: ten document, page and vector operators and their queries.

Nothing outside this subpackage imports it.
"""
