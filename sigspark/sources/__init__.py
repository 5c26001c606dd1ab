"""File formats: readers return DataFrames, writers take them."""
