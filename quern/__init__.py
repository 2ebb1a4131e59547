"""Quern: relational, spatial, full-text and vector queries on Spark."""
