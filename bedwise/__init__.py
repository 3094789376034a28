"""Hospital capacity analytics as composable Spark DataFrame transformations."""
