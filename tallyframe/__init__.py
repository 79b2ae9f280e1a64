"""tallyframe: exploratory analytics over Spark DataFrames.

Every operator is a plain function from DataFrame to DataFrame.  Operators that
need table-level statistics first *fit* them (one bounded aggregate, a single
row or a checked number of groups) and then stay lazy, so the fitted numbers
reach the scan as literals and the fact rows are never shuffled for them.
"""
