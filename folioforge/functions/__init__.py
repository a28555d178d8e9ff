"""Column functions, JVM-side wherever Spark can express them."""
