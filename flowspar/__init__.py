"""flowspar: code-flow analytics and corpus preparation on PySpark DataFrames."""
