"""A PySpark-native engine for content intelligence: ingest, dedup, cluster, rank, serve, evaluate."""
