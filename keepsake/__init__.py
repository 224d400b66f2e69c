"""Table backup, restore and retention as Spark DataFrame plans."""
