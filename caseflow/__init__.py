"""caseflow: claims analytics as composable Spark DataFrame transformations."""
