"""Operators over bar, trade, quote and feature DataFrames."""
