"""Graphloom: subgraph similarity matching and data processing on Spark."""
