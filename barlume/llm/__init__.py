"""Operators of a training-data pipeline: tokenisation, filtering, joins and formatting of text at corpus scale."""
