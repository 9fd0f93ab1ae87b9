"""Writers: text rows as DataFrames, and files."""
