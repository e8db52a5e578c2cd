"""From query forms to DataFrames: parsing, analysis, compilation, rules."""
