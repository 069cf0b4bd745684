"""corpusmill: document quality, safety and training-data analytics on Spark."""
