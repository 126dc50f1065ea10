"""Ordered signals and feature vectors on Spark DataFrames, with exact time and frequency units."""
