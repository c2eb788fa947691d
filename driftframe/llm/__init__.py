"""Training-data operators: documents in, decisions out, as Spark jobs."""
