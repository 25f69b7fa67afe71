"""Per-pixel expressions, fixed values and small plane helpers."""
