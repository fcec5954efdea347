"""Bar analytics and feature engineering on Spark DataFrames."""
