"""Composed multi-operator jobs (each one Spark DAG)."""
