"""Point-cloud forest analytics on Spark."""
