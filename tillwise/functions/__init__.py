"""Column-level building blocks; every one stays inside the JVM."""
