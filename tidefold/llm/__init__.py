"""Operators for preparing large training corpora, written on Spark DataFrames.

Nothing else in the library imports this subpackage.
"""
