"""roadweave: road-telemetry and compliance analytics as lazy Spark DataFrame transformations."""
