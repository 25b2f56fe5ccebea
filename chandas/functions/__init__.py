"""Column -> Column functions; everything stays on the JVM side."""
