"""Spatial access and facility planning as Spark DataFrame jobs."""
