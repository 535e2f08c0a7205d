"""Fantasy-football analytics as Spark DataFrame plans."""
