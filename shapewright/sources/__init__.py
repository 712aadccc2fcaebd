"""Tables and binary files as DataFrames."""
