"""Hourly mobile-network activity analytics as Spark DataFrame jobs."""
