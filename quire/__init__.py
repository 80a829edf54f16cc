"""Order-sensitive document analytics on Spark."""
