"""The row-wise operators on streaming DataFrames."""
