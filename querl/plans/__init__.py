"""From statements to DataFrames: parsing, typing and planning."""
