"""terrafold: territory analytics expressed as Spark DataFrame plans."""
