"""Column builders: numeric scales, text keys, token arrays and score curves. All stay inside the JVM."""
