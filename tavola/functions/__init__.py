"""Column-level building blocks (pure ``Column -> Column`` expressions) and
skew-safe helpers for per-group statistics."""
