"""Column expressions shared by the operators; all run JVM-side."""
