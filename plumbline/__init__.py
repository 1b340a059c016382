"""plumbline: finding-level evaluation, label auditing and preference data as Spark DataFrames."""
