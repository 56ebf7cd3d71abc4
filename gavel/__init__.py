"""Case governance analytics over Spark DataFrames.

Every public operator is a function from DataFrames to a DataFrame (or from
Columns to a Column); see README.md for the list.
"""
