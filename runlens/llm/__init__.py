"""Training-data operators over whole corpora: one module per operator.

Nothing outside this package imports it. ``queries`` registers the operators as
queries over the test tables.
"""
