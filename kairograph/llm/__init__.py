"""Training-data operators: ten document and vector operators plus their queries.

Nothing else in the library imports this subpackage.
"""
