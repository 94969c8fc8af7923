"""Evidence and claim governance as Spark jobs over tables and streams."""
