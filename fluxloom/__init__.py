"""fluxloom: time-domain analytics and corpus preparation on Spark DataFrames."""
