"""Spark-native passage store: bulk ingest, exact nearest-passage search, catalog upkeep."""
