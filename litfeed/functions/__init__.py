"""Column-level functions (JVM expressions first, Arrow UDFs only where needed)."""
