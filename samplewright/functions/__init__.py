"""Column expressions: no function here runs a job or leaves the JVM."""
