"""Markdown corpora as typed, queryable node relations on Spark."""
