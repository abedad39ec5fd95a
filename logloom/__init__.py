"""Log validation, scoring and querying as Spark DataFrame transformations."""
