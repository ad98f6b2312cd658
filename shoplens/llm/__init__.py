"""Training-data operators: tokens, duplicates, packing, filters, search.

Nothing else in the library imports this package.
"""
