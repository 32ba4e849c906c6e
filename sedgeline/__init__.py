"""Sedgeline: sequence, tree and training-text processing on PySpark DataFrames."""
