"""Operators of a large-scale training-data pipeline, their queries and SQL.

Nothing else in the library imports this subpackage; it may import general
helpers of the library.  One module per operator, ``queries`` registers them.
"""
