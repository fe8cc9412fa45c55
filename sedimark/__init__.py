"""sedimark: retrieval-data analytics and training-data preparation on Spark."""
