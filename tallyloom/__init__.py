"""Credit-book analytics as Spark DataFrame operators."""
