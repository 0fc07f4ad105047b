"""Column functions.  Everything here is an expression over built-in Spark functions."""
