"""Spark-native analytics over web collections: pages, records and fetch logs."""
