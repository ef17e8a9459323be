"""Population-structure genotyping as Spark DataFrame and SQL operators."""
