"""Lap analytics and corpus preparation on Spark."""
