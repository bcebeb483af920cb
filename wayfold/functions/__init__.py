"""Column functions of the route engine; all of them stay inside the JVM."""
