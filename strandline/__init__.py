"""Spark-native toolkit for research data: intervals, episodes, lookups, SQL helpers, sources and scalar functions."""
