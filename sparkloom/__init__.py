"""sparkloom: sequence, ranking and graph analytics on Spark DataFrames."""
