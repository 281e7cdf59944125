"""Operators of a large-scale training-data pipeline.

One module per operator; ``catalog`` registers their queries. Nothing else in
the library imports this subpackage.
"""
