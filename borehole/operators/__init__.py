"""Analyses: each takes DataFrames and gives DataFrames."""
