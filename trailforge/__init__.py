"""Search-trajectory analytics and training-data preparation on Spark."""
