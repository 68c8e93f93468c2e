"""cairnflow: relational, time-series and summary analytics on PySpark."""
