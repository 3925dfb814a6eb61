"""waywright: multi-criteria route queries on road graphs, expressed as Spark DataFrames."""
