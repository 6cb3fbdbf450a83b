"""cohortlens: three-valued rule evaluation and cohort analytics on Spark DataFrames."""
