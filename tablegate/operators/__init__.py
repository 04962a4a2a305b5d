"""Checks, joins, aggregations and inference over DataFrames."""
