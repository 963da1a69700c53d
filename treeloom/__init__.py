"""treeloom: tree-pattern matching and distribution analytics on PySpark DataFrames."""
