"""The audit's operators: DataFrames in, DataFrames out."""
