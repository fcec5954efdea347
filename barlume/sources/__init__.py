"""Readers and the market tables derived from the sample star schema."""
