"""quarrylight: corpus search, dependency-graph and snapshot analytics on PySpark DataFrames."""
