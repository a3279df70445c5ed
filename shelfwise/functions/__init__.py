"""Column helpers and scalable ordering built from Spark's own functions."""
