"""Column expressions: every function here takes and returns Columns and runs inside the JVM."""
