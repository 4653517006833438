"""Column-expression building blocks (JVM-side, codegen friendly)."""
