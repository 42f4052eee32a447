"""Column functions; all of them compose built-in functions and stay in the JVM."""
