"""Operators of a training-data pipeline: text, page and archive work over Spark DataFrames.

Each module holds one operator; ``queries`` binds them to the tables of a data folder.
Nothing outside this folder imports it.
"""
