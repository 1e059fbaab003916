"""Readers of graphs and graph views over tables."""
