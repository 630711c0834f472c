"""Operators of a training-data pipeline on Spark DataFrames.

One module per operator; ``registry`` holds the registered queries.  Nothing
else in the library imports this subpackage.
"""
