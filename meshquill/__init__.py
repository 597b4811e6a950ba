"""Directed, typed property-graph analytics on Spark."""
