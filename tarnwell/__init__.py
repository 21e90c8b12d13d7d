"""tarnwell: document search, drift detection, hierarchy planning and link checks on Spark DataFrames."""
