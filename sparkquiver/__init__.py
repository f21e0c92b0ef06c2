"""Spark-first property-graph analytics: graph tables, a Cypher compiler and distributed operators."""
