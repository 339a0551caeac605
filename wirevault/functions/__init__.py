"""Column-expression building blocks. Nothing here triggers a Spark job."""
