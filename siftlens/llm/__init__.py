"""Operators of training-data pipelines, their queries and their SQL. Nothing outside this folder imports it."""
