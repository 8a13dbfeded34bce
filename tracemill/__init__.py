"""Process mining on Spark."""
