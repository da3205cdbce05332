"""Code-structure analytics on Spark."""
