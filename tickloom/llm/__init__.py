"""Operators of a training-data pipeline over documents, pages and conversations.

Nothing outside this folder imports it.  Every operator takes DataFrames and
returns DataFrames; ``queries`` registers one query per operator.
"""
