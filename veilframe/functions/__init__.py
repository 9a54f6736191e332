"""Column functions: each takes and returns Spark columns and runs in the JVM."""
