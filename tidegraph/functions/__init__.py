"""Column functions: plain expressions that stay inside the JVM unless a docstring says otherwise."""
