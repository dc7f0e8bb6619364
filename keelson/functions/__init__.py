"""Column-level helpers: time arithmetic, predicates and text rules (all JVM-side)."""
