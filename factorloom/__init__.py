"""Panel analytics for cross-country equity factors, expressed as Spark DataFrame plans."""
