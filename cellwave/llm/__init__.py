"""Operators for preparing language-model training data, on Spark DataFrames.

Nothing outside this package imports it. ``cellwave.llm.entries`` lists the
registered queries and their SQL.
"""
