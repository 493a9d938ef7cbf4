"""Front ends: the query language and metric expressions, both planned as DataFrames."""
