"""Column builders: pure ``Column -> Column`` helpers, all JVM-side."""
