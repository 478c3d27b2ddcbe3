"""Cross-reference analytics over tables of source-code facts, in DataFrames."""
