"""Trade-log analytics on Spark: many logs at once, as DataFrame plans."""
