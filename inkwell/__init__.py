"""Document-knowledge analytics as lazy Spark plans."""
