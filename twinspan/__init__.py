"""twinspan: duplicate-content analytics as Spark DataFrame plans."""
