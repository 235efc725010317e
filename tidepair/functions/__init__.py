"""Column functions (JVM-side) and Arrow p-value functions."""
