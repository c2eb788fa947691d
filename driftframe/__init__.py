"""Track analytics on Spark: tables of tracked objects in, features and statistics out."""
