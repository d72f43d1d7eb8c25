"""Reachability analytics for scheduled transport, on Spark."""
