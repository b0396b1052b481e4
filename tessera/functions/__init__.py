"""Functions as functions over DataFrames."""
