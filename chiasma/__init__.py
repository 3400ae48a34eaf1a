"""chiasma: recombination analytics as composable Spark DataFrame operators."""
