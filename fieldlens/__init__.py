"""Field-validation analytics on Spark: typed, composable operators over workbooks, maps and cell tables."""
