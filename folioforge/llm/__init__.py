"""Training-data operators: each module holds one operator and its thin query.

Nothing else in the package imports this subpackage.
"""
