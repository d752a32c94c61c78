"""Multi-shop offer analytics on Spark."""
