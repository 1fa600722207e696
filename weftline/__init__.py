"""weftline: analytics operators for Spark, written with the DataFrame, SQL and Structured Streaming APIs."""
