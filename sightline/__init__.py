"""Visual-evidence analytics on PySpark: elements, rasters, evidence, rules, streams."""
