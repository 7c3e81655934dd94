"""Plan text, plan trees, and their DataFrames."""
