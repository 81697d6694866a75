"""Training-data operators: each module holds one operator on plain DataFrames."""
